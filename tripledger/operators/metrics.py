"""Error measures and cost shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label of each cost item and the trip column it sums.
COST_ITEMS = {
    "Air Ticket": "y_air_ticket",
    "Accommodation": "y_hotel",
    "Daily Allowance": "y_daily_allowance",
    "Others": "y_others",
}


def error_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    error = F.col(truth) - F.col(predicted)
    mse = F.avg(error * error)
    return df.agg(F.sqrt(mse).alias("rmse"), mse.alias("mse"))


def hybrid_average(additive: Column, sequence: Column) -> Column:
    return (additive + sequence) / 2


def align_predictions(additive: DataFrame, sequence: DataFrame, key: str) -> DataFrame:
    """Predictions held in two frames, matched by key and averaged."""
    return additive.join(sequence, key).withColumn(
        "hybrid", hybrid_average(F.col("additive"), F.col("sequence"))
    )


def category_shares(train: DataFrame) -> DataFrame:
    """Ratio of sums per cost item over the training trips; null if the total is 0."""
    return train.agg(
        *[F.try_divide(F.sum(c), F.sum("y")).alias(item) for item, c in COST_ITEMS.items()]
    )


def breakdown(total: Column, shares: dict[str, float | None]) -> Column:
    """Map of cost item to its part of the total."""
    pairs = []
    for item in COST_ITEMS:
        pairs += [F.lit(item), total * F.lit(shares[item]).cast("double")]
    return F.create_map(*pairs)


def breakdown_long(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cost item with money rounded for display."""
    return df.select(*keys, F.explode("breakdown").alias("item", "cost")).withColumn(
        "cost", F.round("cost", 2)
    )


def forecast_series(df: DataFrame, keys: list[str]) -> DataFrame:
    """One bar per prediction: additive, sequence and total."""
    return df.unpivot(keys, ["additive", "sequence", "total"], "series", "value")
