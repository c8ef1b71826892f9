"""Evaluation of the additive model from several origins in one pass.

An origin is a position: trips before it train, those from it to the next origin
are held out. Origins cut the ranked trips into segments. One pass adds up a Gram
matrix for each segment; the sum of the matrices of all segments before an origin is
that of its training trips, so no trip is read once more for another refit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.models.additive import (
    AdditiveModel,
    Settings,
    day_facts,
    design_of,
    part_of,
    segment_grams,
    solved,
)
from tripledger.operators.ranks import Ranked, train_size
from tripledger.session import stage


def even_origins(rows: int, number: int, test_fraction: float = 0.2) -> list[int]:
    """``number`` origins at equal distances; the last one is that of the ordered split."""
    last = train_size(rows, test_fraction)
    return sorted({max(2, math.floor(last * k / number)) for k in range(1, number + 1)})


def _segment(origins: Sequence[int]) -> Column:
    """Number of origins at or before a position."""
    return sum((F.col("rn") >= o).cast("int") for o in origins) + F.lit(0)


def fit_origins(
    ranked: Ranked, origins: Sequence[int], labels: Sequence[str], settings: Settings = Settings()
) -> list[AdditiveModel]:
    """The additive model of the trips before each origin, as separate fits give it.

    Every origin has a design of its own: its days, changepoints and scales come
    from a table of days by segment. The Gram matrices hold the numeric columns
    of all designs side by side.
    """
    origins = list(origins)
    if not origins or origins != sorted(set(origins)) or origins[-1] > ranked.count:
        raise ValueError("origins must rise and lie within the trips")
    rows = ranked.before(origins[-1]).filter(F.col("y").isNotNull())
    segment = _segment(origins)
    days = stage(day_facts(rows, segment.alias("segment")), "days")
    designs = [
        design_of(days.filter(F.col("segment") <= k), labels, settings) for k in range(len(origins))
    ]
    grams = segment_grams(rows, designs, segment, len(origins)).cumsum(axis=0)
    return [solved(d, part_of(grams[k], designs, k)) for k, d in enumerate(designs)]


def predict_origins(ranked: Ranked, origins: Sequence[int], models: Sequence[AdditiveModel]) -> DataFrame:
    """``origin``, the trip and ``additive`` for all trips after the first origin.

    Each trip is scored once, by the model of the last origin before it; only
    the files of its own range are read.
    """
    ends = [*origins[1:], ranked.count]
    parts = [
        model.transform(ranked.since(first).filter(F.col("rn") < end)).withColumn("origin", F.lit(first))
        for first, end, model in zip(origins, ends, models, strict=True)
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluate_origins(
    ranked: Ranked, origins: Sequence[int], labels: Sequence[str], settings: Settings = Settings()
) -> DataFrame:
    """One row for each origin: trips held out and the errors of its model on them.

    An origin that no trip follows gives no row.
    """
    models = fit_origins(ranked, origins, labels, settings)
    error = F.col("y") - F.col("additive")
    return (
        predict_origins(ranked, origins, models)
        .groupBy("origin")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(error * error).alias("mse"),
            F.avg(error).alias("bias"),
        )
    )
