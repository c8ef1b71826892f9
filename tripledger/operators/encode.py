"""Country codes over a fixed domain: index, one-hot, feature lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorSizeHint
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.functions.trip import one_hot_flag


def domain_of(countries: DataFrame) -> list[str]:
    """Sorted codes of the country dimension."""
    return [row["code"] for row in countries.select("code").distinct().orderBy("code").collect()]


def indexer(labels: Sequence[str]) -> StringIndexerModel:
    """Position in the domain; null and unknown codes get the extra last index."""
    return StringIndexerModel.from_arrays_of_labels(
        [list(labels)] * 2,
        inputCols=["home_country", "dest_country"],
        outputCols=["home_pos", "dest_pos"],
        handleInvalid="keep",
    )


def one_hot(labels: Sequence[str], sample: DataFrame) -> PipelineModel:
    """``home_vec`` and ``dest_vec``: one slot per code, all zero for unknown codes.

    The widths come from the indexer's column metadata, so no data is read.
    """
    index = indexer(labels)
    encoder = OneHotEncoder(
        inputCols=["home_pos", "dest_pos"], outputCols=["home_vec", "dest_vec"], dropLast=True
    )
    return PipelineModel([index, encoder.fit(index.transform(sample))])


def with_category_index(trips: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Integer positions ``home_idx`` and ``dest_idx``, null outside the domain."""
    known = len(labels)
    return (
        indexer(labels)
        .transform(trips)
        .withColumn("home_idx", F.when(F.col("home_pos") < known, F.col("home_pos").cast("int")))
        .withColumn("dest_idx", F.when(F.col("dest_pos") < known, F.col("dest_pos").cast("int")))
        .drop("home_pos", "dest_pos")
    )


def one_hot_wide(trips: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One 0/1 column per side and code instead of the two country columns."""
    return trips.select(
        *[c for c in trips.columns if c not in ("home_country", "dest_country")],
        *[one_hot_flag(F.col("home_country"), code).alias(f"home_{code}") for code in labels],
        *[one_hot_flag(F.col("dest_country"), code).alias(f"dest_{code}") for code in labels],
    )


def feature_names(columns: Sequence[str], with_target: bool = False) -> list[str]:
    """Model inputs among the columns, by prefix; the target goes first."""
    inputs = [c for c in columns if c.startswith(("home_", "dest_")) or c == "duration"]
    return ["y", *inputs] if with_target else inputs


def declared_size(column: str, size: int) -> VectorSizeHint:
    """States the size of a vector column.

    Without it a later assembler or fit would run a job to look at a first row,
    which costs a pass and is not possible on a stream.
    """
    return VectorSizeHint(inputCol=column, size=size, handleInvalid="optimistic")


def with_country_names(df: DataFrame, column: str, countries: DataFrame, out: str) -> DataFrame:
    """Display name of a code, null for codes outside the dimension."""
    dim = countries.select(F.col("code").alias("dim_code"), F.col("name").alias(out))
    return df.join(dim, F.col(column) == F.col("dim_code"), "left").drop("dim_code")
