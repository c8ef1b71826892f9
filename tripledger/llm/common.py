"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.session import Scratch, bounded_batches


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(documents: DataFrame, *others: str) -> DataFrame:
    """``doc_id``, ``text`` (null becomes empty) and the named columns, nothing else.

    Every operator starts from these, so extra columns, whatever their names,
    can never clash with its own.
    """
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *(F.col(name) for name in others),
    )


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def map_batches(
    df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function on one batch; an empty input gives an empty output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of two or three numbers that may be broadcast, some 20 MB; beyond that a join shuffles.
BROADCAST_ROWS = 500_000


def broadcast_within(side: DataFrame, rows: int) -> DataFrame:
    """Hint a narrow side whose counted ``rows`` are few; the result is the same without."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def pieces_of(items: list, limit: int, weight: Callable) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose summed weight stays near ``limit``.

    An item of ``limit`` or more stands alone.
    """
    start, held = 0, 0
    for k, item in enumerate(items):
        if weight(item) >= limit and k > start:
            yield start, k
            start, held = k, 0
        held += weight(item)
        if held >= limit:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(items):
        yield start, len(items)


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of an undirected graph: ``node`` and ``root``, its smallest member.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Each round
    is a large-star and a small-star step; every step is an aggregation with
    map-side minima and a join, so a node with very many links is no single
    task's burden. Rounds are written to the shared folder, which cuts the
    lineage. Only nodes with a link are returned.
    """
    current = edges.where("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    ).distinct()
    path = scratch.path("links")
    current = scratch._stage_at(current, path)
    before = None
    while True:
        now = current.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("h")
        ).first()
        if tuple(now) == before or now["n"] == 0:
            break
        before = tuple(now)
        both = current.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            current.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")
        )
        # Large star: each larger neighbour moves to the smallest neighbour.
        large = (
            current.join(least, current.lo == least.u)
            .select(F.col("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        # Small star: smaller neighbours and the node itself move to their smallest.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(low, "hi")
            .select(F.explode(F.array(
                F.struct(F.col("hi"), F.col("m").alias("lo")),
                F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
            )).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        newer = scratch.path("links")
        current = scratch._stage_at(small, newer)
        scratch.release(path)
        path = newer
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        current.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def hashed_grams(data: np.ndarray, size: int, bits: int) -> np.ndarray:
    """``bits``-bit hashes of all runs of ``size`` bytes, one for each start."""
    n = max(0, len(data) - size + 1)
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h *= np.uint32(0x01000193)
        h ^= data[k : k + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


#: Texts that one id gives to a sample of labelled ids.
TEXTS_PER_ID = 8


def few_of_each(rows: DataFrame, most: int = TEXTS_PER_ID) -> DataFrame:
    """At most ``most`` rows of each ``doc_id``, by a hash of ``text``.

    Rows beyond that are dropped before the shuffle, so an id with very many
    rows gathers no more than ``most`` from each task.
    """
    nth = fresh(rows, "nth")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return rows.withColumn(nth, F.row_number().over(order)).where(F.col(nth) <= most).drop(nth)


def balanced_sample(rows: DataFrame, label: str, *key: str, most: int) -> tuple[DataFrame, dict]:
    """About ``most`` rows for each value of ``label``, chosen by a hash of ``key``.

    ``key`` should tell rows apart, since rows of one key are drawn or left together.

    Returns the sample and the count of all rows by value. Values with fewer
    rows are kept whole. The rates follow the counts of all rows, so the
    sample's size does not grow with the input.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0), counts
    rate = F.create_map(
        *(F.lit(x) for value, n in sorted(counts.items()) for x in (value, min(1.0, most / n)))
    )
    drawn = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    return rows.where(drawn < rate[F.col(label)]), counts
