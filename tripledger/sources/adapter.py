"""Expense lines, rates, domain and requests made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.session import scratch_path

OUTSIDE_DOMAIN = "NATION_24"
RATED_NATIONS = 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder to stream a table from: its own, or a copy of its only file.

    A stream reads folders. A table that is a single file is copied below the
    shared folder, so that its neighbours are not read with it.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return f"{sf_dir}/{name}.parquet"
    copied = scratch_path(spark, name)
    table(spark, sf_dir, name).write.parquet(copied)
    return copied


def _expense_type(flag: Column, status: Column) -> Column:
    return (
        F.when((flag == "R") & (status == "F"), "HOTEL")
        .when((flag == "R") & (status == "O"), "AIR TICKET")
        .when((flag == "A") & (status == "F"), "DAILY ALLOWANCE")
        .when((flag == "A") & (status == "O"), "TAXI")
        .when((flag == "N") & (status == "F"), "FUEL")
    )


def amount_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines say without any join: trip, expense type and amount."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("report_key"),
        _expense_type(F.col("l_returnflag"), F.col("l_linestatus")).alias("expense_type"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_eur"),
    )


def expense_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One expense line per order line: the order is the trip.

    A line whose order, customer, supplier or nation is missing stays, with nulls.
    Joins carry no hints: sizes at run time decide between broadcast and
    shuffle, and adaptive skew handling splits a hot customer or supplier. They
    are left-deep, so each right side is a base table with a known size.
    """
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    dest_nation = nation.select(
        F.col("n_nationkey").alias("dest_key"), F.col("n_name").alias("dest_country")
    )
    start = F.to_date("o_orderdate")
    trips = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            "o_orderkey",
            F.col("n_name").alias("home_country"),
            F.date_format(start, "yyyyMMdd").alias("start_date_raw"),
            F.date_format(
                F.date_add(start, (F.col("o_orderkey") % 15).cast("int")), "yyyyMMdd"
            ).alias("end_date_raw"),
        )
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(dest_nation, F.col("s_nationkey") == F.col("dest_key"), "left")
        .join(trips, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.lit("EUR").alias("currency_key"),
            F.lit("Euro").alias("currency_name"),
            "dest_country",
            F.when(F.col("home_country") == F.col("dest_country"), "DOMESTIC")
            .otherwise("FOREIGN")
            .alias("dom_intl_flag"),
            "end_date_raw",
            _expense_type(F.col("l_returnflag"), F.col("l_linestatus")).alias("expense_type"),
            "home_country",
            F.col("l_orderkey").alias("report_key"),
            "start_date_raw",
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount_eur"),
            F.struct(
                "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
            ).alias("row_ord"),
        )
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_nationkey") < RATED_NATIONS)
        .select(
            F.col("n_name").alias("country"),
            (F.lit(40.0) + F.lit(5.0) * F.col("n_nationkey")).alias("daily_allowance"),
        )
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country domain; one nation stays outside it."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .filter(F.col("n_name") != OUTSIDE_DOMAIN)
        .select(
            F.col("n_name").alias("code"),
            F.concat_ws(" / ", "r_name", "n_name").alias("name"),
        )
    )


def requests(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """One forecast request per customer; a streaming customer table works too."""
    if customers is None:
        customers = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    home = nation.select(F.col("n_nationkey").alias("home_key"), F.col("n_name").alias("home_country"))
    dest = nation.select(F.col("n_nationkey").alias("dest_key"), F.col("n_name").alias("dest_country"))
    key = F.col("c_custkey")
    return (
        customers.select(
            key.alias("request_id"),
            F.col("c_nationkey").alias("home_key"),
            ((key * 7 + F.col("c_nationkey")) % 25).cast("int").alias("dest_key"),
            (key % 21).cast("int").alias("num_days"),
            (key % 12 + 1).cast("int").alias("month"),
            F.when(key % 3 != 0, 1998 + key % 2).cast("int").alias("year"),
        )
        .join(home, "home_key")
        .join(dest, "dest_key")
        .select("request_id", "home_country", "dest_country", "num_days", "month", "year")
    )
