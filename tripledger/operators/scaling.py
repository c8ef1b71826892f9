"""Min-max scaling to [0, 1] without clipping; a constant column has range 1."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def extremes(train: DataFrame) -> DataFrame:
    """Trips per home and per destination, and the extremes over all trips.

    One grouping-sets aggregation: a row per code and side, plus unknown codes
    and the grand total. The wide one-hot columns are never built.
    """
    return train.groupingSets(
        [[F.col("home_idx")], [F.col("dest_idx")], []], F.col("home_idx"), F.col("dest_idx")
    ).agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.min("duration").cast("double").alias("duration_min"),
        F.max("duration").cast("double").alias("duration_max"),
    )


# Level of the grouping sets above that counts each side, and of the grand total.
_LEVELS = {"home": 1, "dest": 2}
_TOTAL = 3


@dataclass(frozen=True)
class MinMax:
    """Fitted scaling; one (min, max) pair per feature."""

    bounds: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, labels: Sequence[str]) -> MinMax:
        """A one-hot column reaches 1 where its code occurs and stays 1 where all rows have it.

        What is collected is bounded by the domain: two rows per code plus three.
        """
        rows = extremes(train).collect()
        total = next(r for r in rows if r["level"] == _TOTAL)
        bounds = {c: (total[f"{c}_min"], total[f"{c}_max"]) for c in ("y", "duration")}
        for side, level in _LEVELS.items():
            seen = {r[f"{side}_idx"]: r["n"] for r in rows if r["level"] == level}
            for i, code in enumerate(labels):
                n = seen.get(i, 0)
                bounds[f"{side}_{code}"] = (float(n == total["n"]), float(n > 0))
        return cls(bounds)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(f, low, high) for f, (low, high) in self.bounds.items()],
            "feature string, min double, max double",
        )

    @classmethod
    def from_table(cls, table: DataFrame) -> MinMax:
        return cls({r["feature"]: (r["min"], r["max"]) for r in table.collect()})

    def span(self, feature: str) -> float:
        low, high = self.bounds[feature]
        return (high - low) or 1.0

    def scale(self, feature: str, value: Column) -> Column:
        return (value - F.lit(self.bounds[feature][0])) / F.lit(self.span(feature))

    def restore(self, feature: str, value: Column) -> Column:
        return value * F.lit(self.span(feature)) + F.lit(self.bounds[feature][0])

    def always_on(self, side: str, labels: Sequence[str]) -> set[int]:
        """Positions whose one-hot column is 1 in every training row: it scales to 0."""
        return {i for i, code in enumerate(labels) if self.bounds[f"{side}_{code}"][0] == 1.0}

    def scaled_slot(self, side: str, labels: Sequence[str]) -> Column:
        """Scaled value of a row's own one-hot column, 0 for codes outside the domain."""
        position = F.col(f"{side}_idx")
        off = position.isNull()
        constant = sorted(self.always_on(side, labels))
        if constant:
            off = off | position.isin(constant)
        return F.when(off, 0.0).otherwise(1.0)
