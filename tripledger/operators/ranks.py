"""Exact positions in key order, the ordered split and the tail."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.session import stage


@dataclass(frozen=True)
class Ranked:
    """Rows with their 0-based position ``rn`` and the number of rows.

    ``placed`` are the written rows by partition, ``starts`` the first position
    of each partition.
    """

    placed: DataFrame
    count: int
    starts: list[tuple[int, int]] = field(default_factory=list)

    def _numbered(self, placed: DataFrame) -> DataFrame:
        """The first positions are a constant of the plan, one number per partition: no join."""
        first = dict(self.starts)
        numbers = ", ".join(f"{first.get(p, 0)}L" for p in range(max(first, default=0) + 1))
        return placed.withColumn("rn", F.expr(f"get(array({numbers}), part) + pos")).drop(
            "part", "pos"
        )

    @property
    def rows(self) -> DataFrame:
        return self._numbered(self.placed)

    def since(self, first: int) -> DataFrame:
        """Rows from a position on; files of earlier partitions are skipped by ``part``."""
        part = max((p for p, start in self.starts if start <= first), default=0)
        return self._numbered(self.placed.filter(F.col("part") >= part)).filter(
            F.col("rn") >= first
        )

    def before(self, end: int) -> DataFrame:
        """Rows up to a position; files of later partitions are skipped by ``part``."""
        part = max((p for p, start in self.starts if start < end), default=0)
        return self._numbered(self.placed.filter(F.col("part") <= part)).filter(F.col("rn") < end)


def rank_rows(df: DataFrame, *order_by: str, name: str = "ranked") -> Ranked:
    """Position of every row in the order of ``order_by``, which must be a total order.

    A range partitioning and a sort within partitions give each row its place
    in its partition; partition sizes give the offsets. The sorted rows are
    written once, because range bounds are sampled: counting and numbering must
    see the same partitions. No step sorts the table in one task; what reaches
    the driver is one number per partition.
    """
    order = [F.col(c) for c in order_by]
    part = F.spark_partition_id()
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # The id holds the partition in its upper 31 bits and the row below them.
        .withColumn("part", part)
        .withColumn("pos", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)),
        name,
    )
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())
    offsets, total = [], 0
    for number, size in sizes:
        offsets.append((number, total))
        total += size
    return Ranked(placed, total, offsets)


def train_size(n: int, test_fraction: float = 0.2) -> int:
    """Rows before the hold-out, which is the last ``ceil(fraction * n)`` rows."""
    train = n - math.ceil(test_fraction * n)
    if train < 1:
        raise ValueError(f"{n} rows cannot be split into a training and a test part")
    return train


def with_split(ranked: Ranked, test_fraction: float = 0.2) -> DataFrame:
    return ranked.rows.withColumn(
        "is_train", F.col("rn") < train_size(ranked.count, test_fraction)
    )


def history_tail(train: DataFrame, length: int) -> DataFrame:
    """The last ``length`` rows by position."""
    return train.orderBy(F.desc("rn")).limit(length)
