"""Readers and writers of expense lines, rates, requests and forecasts.

CSV readers check the header by name and order, and lose nothing: a row that
does not fit the schema is an error, or goes whole to a folder of rejects that
the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tripledger.schemas import EXPENSE_LINE_COLUMNS, EXPENSE_LINE_FILE, RATE, REQUEST

REJECTED = "_rejected"


def scan_csv(
    spark: SparkSession, path: str, schema: StructType, rejects: str | None = None
) -> DataFrame:
    """Rows of CSV files with a header that names the schema's columns in order.

    A row is bad if it has more or fewer fields than the header, or a value that
    is not of its column's type. Without ``rejects`` the first bad row fails the
    job. With it, bad rows are appended there as text (column ``record``) at
    once, and the others are returned.
    """
    text = StructType(
        [StructField(f.name, StringType()) for f in schema]
        + [StructField(REJECTED, StringType())]
    )
    # Values are read as text and cast here: Spark's parser looks at used columns only.
    rows = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", REJECTED)
        .schema(text)
        .csv(path)
    )
    columns = {f.name: F.col(f"`{f.name}`") for f in schema}
    cast = {f.name: columns[f.name].try_cast(f.dataType) for f in schema}
    bad = F.col(REJECTED).isNotNull()
    for f in schema:
        if not isinstance(f.dataType, StringType):
            bad = bad | (columns[f.name].isNotNull() & cast[f.name].isNull())
    record = F.coalesce(F.col(REJECTED), F.concat_ws(",", *columns.values()))
    if rejects is None:
        message = F.concat(F.lit("bad row in "), F.col("_metadata.file_path"), F.lit(": "), record)
        good = rows.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))
    else:
        rows.filter(bad).select(
            record.alias("record"), F.col("_metadata.file_path").alias("file")
        ).write.mode("append").parquet(rejects)
        good = rows.filter(~bad)
    return good.withColumns({f.name: cast[f.name] for f in schema}).drop(REJECTED)


def count_rejects(spark: SparkSession, rejects: str) -> int:
    return spark.read.parquet(rejects).count()


def scan_expense_lines(spark: SparkSession, path: str, rejects: str | None = None) -> DataFrame:
    """CSV expense lines with a ``row_ord`` that follows the order in the files.

    A large file is read in several blocks, so the order is (file, block, row
    within the block). Trip keys are numbers; any other text is a bad row.
    """
    lines = scan_csv(spark, path, EXPENSE_LINE_FILE, rejects)
    amount = F.col("`Amount in EUR`")
    return lines.select(
        *[
            F.col(f"`{name}`").alias(ours)
            for name, ours in EXPENSE_LINE_COLUMNS.items()
            if ours != "amount_eur"
        ],
        F.when(~F.isnan(amount), amount).alias("amount_eur"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("row_ord"),
    )


def write_expense_lines(lines: DataFrame, path: str) -> None:
    lines.select(
        *[F.col(ours).alias(name) for name, ours in EXPENSE_LINE_COLUMNS.items()]
    ).write.csv(path, header=True, mode="overwrite")


def _scan(
    spark: SparkSession, path: str, fmt: str, schema: StructType, rejects: str | None
) -> DataFrame:
    if fmt == "csv":
        return scan_csv(spark, path, schema, rejects).select(*schema.names)
    return spark.read.schema(schema).format(fmt).load(path)


def scan_rates(
    spark: SparkSession, path: str, fmt: str = "csv", rejects: str | None = None
) -> DataFrame:
    return _scan(spark, path, fmt, RATE, rejects)


def write_rates(rates: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = rates.select("country", "daily_allowance").write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def scan_requests(
    spark: SparkSession, path: str, fmt: str = "csv", rejects: str | None = None
) -> DataFrame:
    return _scan(spark, path, fmt, REQUEST, rejects)


def write_forecasts(forecasts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    forecasts.write.mode(mode).parquet(path)
