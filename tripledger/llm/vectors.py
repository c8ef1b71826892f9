"""Exact top-k search by inner product with vector-approximation files.

Each component of a vector is replaced by the number of its cell, one byte; the
cells of a dimension are equally wide and cover its range over all rows. The
middle of the cells gives an inner product with a query that is off by at most
half a cell in each dimension, so it bounds the exact score from both sides. A
scan of the cells orders a block's vectors by their bound; the best k are read
exactly, which raises the query's k-th score, and then those whose bound still
reaches it. All others are certain not to be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.llm.common import read_table

SCALE = 1024
#: Scaled components must be smaller, so that their differences fit a long.
LARGEST = 2**61
#: Queries that are sent to the executors at once; more take several passes over the table.
QUERY_BLOCK = 20_000
QUERY_CHUNK = 256
ROWS = 4096
PAIRS = 1 << 18

Vectors = tuple[np.ndarray, np.ndarray]  # ids, integer components


def whole_vectors(table: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``, the scaled integer components, of the rows that take part.

    Rows with a null id, a null vector or a component that is null or not finite
    take no part. A component of 2**51 or more, which scaled does not fit, is an
    error.
    """
    x = F.col("embedding")

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    good = F.forall(x, lambda c: finite(c.cast("double")))
    too_large = F.raise_error("a component is too large for exact scores").cast("long")

    def scaled(c: Column) -> Column:
        # Later filters may be evaluated before the one above: what is dropped is no error.
        small = F.abs(c) < LARGEST / SCALE
        return F.when(small, F.floor(c * SCALE)).when(finite(c), too_large)

    return table.where(F.col("vec_id").isNotNull() & x.isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: scaled(c.cast("double"))).alias("v"),
    )


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


class Cells:
    """Equal cells in each dimension, at most 256 of them, over the range of all rows."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low = low
        self.width = np.maximum(1, -(-(high - low + 1) // 256))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return self.low + cells * self.width + (self.width - 1) / 2

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """How far a score may lie from the middles' score, with room for rounding."""
        off = np.abs(queries) @ ((self.width - 1) / 2)
        return off + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(self.low), 256 * self.width)) + 1e-3


class Best:
    """The k best scores of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.iinfo(np.int64).max)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def worst(self, queries: slice) -> np.ndarray:
        return self.score[queries, -1]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(query)
        row = np.concatenate([np.repeat(some, self.k), query])
        score = np.concatenate([self.score[some].ravel(), score])
        ids = np.concatenate([self.id[some].ravel(), ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = nth < self.k
        self.score[row[kept], nth[kept]] = score[kept]
        self.id[row[kept], nth[kept]] = ids[kept]


def search_block(queries: Vectors, rows: Vectors, cells: Cells, best: Best) -> None:
    """Bring ``best`` up to date with a block of rows; a query's own id is left out."""
    query_id, query = queries
    row_id, row = rows
    middle = cells.middles(cells.of(row))
    for at in range(0, len(query), QUERY_CHUNK):
        some = slice(at, at + QUERY_CHUNK)
        near = query[some] @ middle.T
        slack = cells.slack(query[some])
        near[query_id[some, None] == row_id[None, :]] = -np.inf
        k = min(best.k, len(row))
        first = np.argpartition(-near, k - 1, axis=1)[:, :k]
        q = np.repeat(np.arange(len(near)), k)
        _read(queries, rows, at, q, first.ravel(), near, best)
        near[q, first.ravel()] = -np.inf
        reach = near + slack[:, None] >= best.worst(some)[:, None]
        _read(queries, rows, at, *np.nonzero(reach & np.isfinite(near)), near, best)


def _read(queries, rows, at, q, x, near, best) -> None:
    kept = np.isfinite(near[q, x])
    q, x = q[kept], x[kept]
    for start in range(0, len(q), PAIRS):
        a, b = q[start : start + PAIRS], x[start : start + PAIRS]
        best.add(at + a, products(queries[1][at + a], rows[1][b]), rows[0][b])


def products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; one that does not fit a long is an error.

    Sums that could pass 64 bits are made of Python's integers.
    """
    largest = [int(np.abs(side).max(initial=0)) for side in (one, other)]
    if largest[0] * largest[1] * one.shape[1] < 2**63:
        return np.einsum("ij,ij->i", one, other)
    exact = [sum(map(mul, x, y)) for x, y in zip(one.tolist(), other.tolist(), strict=True)]
    if max(map(abs, exact), default=0) >= 2**63:
        raise ValueError("a score does not fit a long")
    return np.array(exact, np.int64)


FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` best rows.

    ``vectors`` is what ``whole_vectors`` returns. Vectors are compared with
    those of the same length only. Repeated rows count as often as they come; a
    row with the query's id is never its result. An empty table gives no row.
    """
    spark = vectors.sparkSession
    widths = [
        (r["width"], r["queries"])
        for r in vectors.groupBy(F.size("v").alias("width"))
        .agg(F.count(F.when(is_query, 1)).alias("queries"))
        .collect()
    ]
    parts = []
    for width, queries in sorted(widths):
        if not queries:
            continue
        same = vectors.where(F.size("v") == width)
        if width:
            bounds = same.select(F.posexplode("v").alias("d", "c")).groupBy("d").agg(
                F.min("c").alias("low"), F.max("c").alias("high")
            )
            bounds = bounds.orderBy("d").collect()
        else:
            bounds = []
        cells = Cells(
            np.array([b["low"] for b in bounds], np.int64),
            np.array([b["high"] for b in bounds], np.int64),
        )
        blocks = -(-queries // QUERY_BLOCK)
        for block in range(blocks):
            # A block is a share of the ids by hash, about QUERY_BLOCK of them.
            mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block
            held = same.where(is_query & mine).dropDuplicates(["vec_id", "v"]).orderBy("vec_id")
            rows = held.collect()
            if rows:
                shared = spark.sparkContext.broadcast(
                    (
                        np.array([r["vec_id"] for r in rows], np.int64),
                        np.array([r["v"] for r in rows], np.int64).reshape(len(rows), width),
                        cells,
                    )
                )
                parts.append(same.mapInArrow(_searcher(shared, width, k), FOUND))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _searcher(shared, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_id, query, cells = shared.value
        best = Best(len(query_id), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False)
                rows = _matrix(part.column("v"), width) if width else np.zeros((len(ids), 0), int)
                search_block((query_id, query), (ids, rows), cells, best)
        there = best.id != np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_id, there.sum(axis=1))),
                pa.array(best.id[there]),
                pa.array(best.score[there]),
            ],
            ["query_id", "vec_id", "score"],
        )

    return run


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 100 == 0, 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
           AS rank,
         vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
