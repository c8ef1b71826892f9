"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Tasks centre the distinct vectors and add up partial scatter matrices. The scatter
of D dimensions, D squared numbers, is factored on the driver: pivoted Cholesky
gives a triangular factor, whose columns one-sided Jacobi rotates until they are
orthogonal. Their squared norms are the scatter's eigenvalues and the normalised
columns its eigenvectors; no product of the factor with itself is ever formed, so
small eigenvalues keep their digits beside large ones. Tasks then project every
row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.common import read_table
from tripledger.session import Scratch

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
#: Rows that a task holds as doubles at once.
ROWS = 4096
#: Sums and products of whole numbers below this are exact in 64 bits.
SAFE = 1 << 62
#: The widest vectors that are fitted: the scatter matrix then takes 128 MB.
WIDEST = 4096
EPS = float(np.finfo(float).eps)


def whole_vectors(table: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, the shifted whole components, of the rows that take part.

    Rows whose vector is null or holds a null or non-finite entry take no part;
    a null ``vec_id`` stays. An entry too large for a long is an error.
    """
    c = F.col("embedding")

    def finite(e: Column) -> Column:
        return e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))

    good = F.forall(c, lambda e: finite(e.cast("double")))
    fits = F.lit(float(SAFE) / SCALE)
    too_large = F.raise_error("an embedding's entry does not fit a long").cast("long")

    def whole(e: Column) -> Column:
        # Later filters may be evaluated before the one above: what is dropped is no error.
        return F.when(F.abs(e) < fits, F.floor(e * SCALE) + SHIFT).when(finite(e), too_large)

    return table.where(c.isNotNull() & good).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(c, lambda e: whole(e.cast("double"))).alias("x"),
    )


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(-1, width)


def _summed(df: DataFrame, width: int, shape: tuple[int, int], part: Callable) -> np.ndarray:
    """Sum over all rows of a matrix of doubles that ``part`` makes of some of them.

    Each task sends one matrix, row by row; rows of a number meet in one task,
    which adds them up, so the driver gets one matrix whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _matrices(batches, width):
            total += part(x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(shape[0], dtype=np.int32)),
                pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), shape[1]).cast(
                    pa.list_(pa.float64())
                ),
            ],
            ["i", "v"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            for i, row in zip(batch.column("i").to_pylist(), values.reshape(-1, shape[1]), strict=True):
                total[i] = total[i] + row if i in total else row
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()])],
                ["i", "v"],
            )

    schema = "i int, v array<double>"
    out = np.zeros(shape)
    for row in df.mapInArrow(run, schema).repartition("i").mapInArrow(add, schema).collect():
        out[row["i"]] = row["v"]
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``L`` and the order of rows with ``a[order][:, order] = L @ L.T``.

    ``L`` has as many columns as ``a`` has rank: a row is used up when what is
    left of its diagonal is rounding error of that diagonal, so rows of very
    different size are each judged by their own.
    """
    size = len(a)
    left, order = np.array(a, float), np.arange(size)
    first = np.diag(a).copy()
    factor = np.zeros((size, size))
    rank = 0
    while rank < size:
        rest = np.diag(left)[rank:]
        alive = rest > 4 * size * EPS * first[order[rank:]]
        if not alive.any():
            break
        pivot = rank + int(np.argmax(np.where(alive, rest, -np.inf)))
        for held in (left, factor):
            held[[rank, pivot]] = held[[pivot, rank]]
        left[:, [rank, pivot]] = left[:, [pivot, rank]]
        order[[rank, pivot]] = order[[pivot, rank]]
        root = np.sqrt(left[rank, rank])
        column = left[rank:, rank] / root
        factor[rank:, rank] = column
        left[rank:, rank:] -= np.outer(column, column)
        rank += 1
    return factor[:, :rank], order


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns, rotated in pairs until all are orthogonal to each other.

    A round rotates disjoint pairs at once; the rounds of a sweep bring every
    pair together. A sweep without a rotation ends it.
    """
    g = np.array(factor, float)
    size = g.shape[1]
    if size < 2:
        return g
    players = np.arange(size + size % 2)
    half = len(players) // 2
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(players) - 1):
            p, q = players[:half], players[half:][::-1]
            there = (p < size) & (q < size)
            rotated |= _rotate(g, p[there], q[there])
            players = np.concatenate([players[:1], players[-1:], players[1:-1]])
        if not rotated:
            return g
    raise RuntimeError(f"Jacobi rotations did not converge in {sweeps} sweeps")


def _rotate(g: np.ndarray, p: np.ndarray, q: np.ndarray) -> bool:
    """Rotate the column pairs that are not orthogonal; whether there were any."""
    a, b = g[:, p], g[:, q]
    alpha, beta = (a * a).sum(axis=0), (b * b).sum(axis=0)
    gamma = (a * b).sum(axis=0)
    wide = np.abs(gamma) > 8 * EPS * np.sqrt(alpha) * np.sqrt(beta)
    if not wide.any():
        return False
    p, q, a, b = p[wide], q[wide], a[:, wide], b[:, wide]
    zeta = (beta[wide] - alpha[wide]) / (2 * gamma[wide])
    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
    c = 1 / np.hypot(1, t)
    s = c * t
    g[:, p], g[:, q] = c * a - s * b, s * a + c * b
    return True


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues in falling order and unit eigenvectors, one a column.

    The largest entry of an eigenvector is positive.
    """
    factor, order = pivoted_cholesky(scatter)
    g = jacobi_columns(factor)
    norm = np.linalg.norm(g, axis=0)
    falling = np.argsort(-norm, kind="stable")
    vectors = np.zeros((len(scatter), len(norm)))
    vectors[order] = (g / norm)[:, falling]
    if len(norm):
        largest = np.abs(vectors).argmax(axis=0)
        vectors *= np.sign(vectors[largest, np.arange(len(norm))])
    return norm[falling] ** 2, vectors


@dataclass(frozen=True)
class Whitening:
    """A fit: number of distinct vectors, exact sums, components and their variances."""

    n: int
    sums: tuple[int, ...]
    variances: np.ndarray  # of the kept components, divisor n
    components: np.ndarray  # one a column
    trace: float  # of the covariance matrix
    largest: int  # absolute whole part of a centred entry

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` as doubles; the whole part is taken off exactly."""
        whole, part = self.middle()
        return (x - whole).astype(float) - part / self.n

    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole parts and remainders of the means: ``S = n * whole + part``."""
        pairs = [divmod(s, self.n) for s in self.sums]
        return np.array([w for w, _ in pairs], np.int64), np.array([p for _, p in pairs], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.variances))

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of ``(n * x - S) ** 2``, exact.

        With x = whole + u it is n^2 u.u - 2 n u.part + part.part; the three
        products are summed in 64 bits where they fit and then put together.
        """
        whole, part = self.middle()
        u = x - whole
        bound = max(int(np.abs(u).max(initial=0)), self.n)
        if bound**2 * len(whole) < SAFE:
            squares, mixed = (u * u).sum(axis=1).tolist(), (u @ part).tolist()
        else:
            u = u.astype(object)
            squares, mixed = (u * u).sum(axis=1).tolist(), (u @ part.astype(object)).tolist()
        own = sum(int(p) ** 2 for p in part)
        return [self.n**2 * s - 2 * self.n * m + own for s, m in zip(squares, mixed, strict=True)]


def fit(vectors: DataFrame, width: int, most: int = COMPONENTS) -> Whitening | None:
    """Fit on ``x`` rows of one width, each distinct vector once already.

    None where all vectors are one, or there is none: nothing varies then.
    Components beyond the rank of the covariance do not exist and are not given.
    """
    if width > WIDEST:
        raise ValueError(f"vectors of {width} dimensions; the fit takes {WIDEST} at most")
    totals = (
        vectors.select(F.posexplode("x").alias("d", "x"))
        .groupBy("d")
        .agg(
            F.sum(F.col("x").cast("decimal(38,0)")).alias("s"),
            F.count("*").alias("n"),
            F.min("x").alias("low"),
            F.max("x").alias("high"),
        )
        .orderBy("d")
        .collect()
    )
    if not totals:
        return None
    n, sums = totals[0]["n"], tuple(int(r["s"]) for r in totals)
    largest = max(r["high"] - r["low"] for r in totals)
    if largest >= SAFE:
        raise ValueError("components differ by more than 64-bit differences hold")
    blank = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0, largest)

    def part(x: np.ndarray) -> np.ndarray:
        c = blank.centred(x)
        return c.T @ c

    scatter = _summed(vectors, width, (width, width), part)
    values, components = eigen(scatter)
    if not len(values):
        return None
    trace = float(np.trace(scatter)) / n
    return Whitening(n, sums, values[:most] / n, components[:, :most], trace, largest)


def identity_error(model: Whitening, vectors: DataFrame) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, measured."""
    size = len(model.variances)

    def part(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = _summed(vectors, len(model.sums), (size + 1, size), part) / model.n
    covariance = found[:size] - np.outer(found[size], found[size])
    return float(np.abs(covariance - np.eye(size)).max())


RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"
)


def transform(model: Whitening, vectors: DataFrame) -> DataFrame:
    """One row for each row of ``vec_id`` and ``x`` and each component of the model.

    ``deviation`` is exact; it is null beyond 38 digits.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        size = len(model.variances)
        for part, x in _matrices(batches, len(model.sums)):
            rows = len(x)
            far = pa.array(
                [str(d) if d < 10**38 else None for d in model.deviation(x)], pa.string()
            ).cast(pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(rows), size))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * size, model.n)),
                    far.take(each),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.explained, rows)),
                ],
                [field.split()[0] for field in RESULT.split(", ")],
            )

    return vectors.mapInArrow(run, RESULT)


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every row of ``vec_id`` and ``embedding``.

    Vectors of one length are a space of their own with its own fit. The fit
    list holds each distinct vector once; it is written, because three passes
    read it. Repeated rows come out as often as they go in. Where nothing varies
    (no row, one distinct vector, vectors without entries) there is no component
    and no row. Other columns are not read.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table)
    scratch = Scratch(spark, "whitening")
    distinct = scratch.stage(vectors.select("x").distinct(), "distinct")
    widths = [r["w"] for r in distinct.select(F.size("x").alias("w")).distinct().collect()]
    parts = []
    for width in sorted(widths):
        listed = distinct.where(F.size("x") == width)
        model = fit(listed, width, most) if width else None
        if model is not None:
            rows = transform(model, vectors.where(F.size("x") == width))
            error = identity_error(model, listed)
            parts.append(rows.withColumn("identity_error", F.lit(error)))
    scratch.release()
    if not parts:
        return spark.createDataFrame([], f"{RESULT}, identity_error double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator over all embeddings; a deviation beyond a long is null."""
    found = whiten(read_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
