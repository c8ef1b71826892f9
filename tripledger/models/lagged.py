"""Linear window learner without windows: least squares from lag products.

A window of L steps is L shifted copies of one step, so the Gram matrix of all
windows consists of the products of steps that lie 0 to L positions apart, summed
over the table, less the few windows that begin before its first row or end
behind its last. One pass adds up these products; the normal equations are then
solved on the driver by conjugate gradients, whose products with the Gram matrix
are sums over lags. No window is built, and nothing is read twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.operators.gram import summed_matrix
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import SEQUENCE_LENGTH

#: Rows whose products are added up between two copies of a window's length.
BLOCK_ROWS = 65_536
#: Ranked rows per task; a task sends its sums, some 12 MB for 77 countries, once.
ROWS_PER_PARTITION = 4_194_304
PENALTY = 0.01
TOLERANCE = 1e-12
MAX_ITERATIONS = 20_000
#: A column whose spread is below this share of its square is constant.
CONSTANT = 1e-10


@dataclass(frozen=True)
class Layout:
    """Places in the vector of one step: a one, the numbers, a slot for each code and side."""

    codes: int

    @property
    def width(self) -> int:
        return 3 + 2 * self.codes

    def slot(self, side: str) -> int:
        return 3 + (self.codes if side == "dest" else 0)

    def dense(self, y, duration, home, dest) -> np.ndarray:
        """Steps as rows; a country outside the domain has no slot."""
        out = np.zeros((len(y), self.width))
        out[:, 0], out[:, 1], out[:, 2] = 1.0, y, duration
        for side, position in (("home", home), ("dest", dest)):
            known = np.flatnonzero((position >= 0) & (position < self.codes))
            out[known, self.slot(side) + position[known]] = 1.0
        return out


def _steps(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    numbers = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "duration")]
    codes = [
        batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in ("home_idx", "dest_idx")
    ]
    return (*numbers, *codes)


def _add_products(total: np.ndarray, layout: Layout, lag: int, earlier, later) -> None:
    """Add the products of paired steps ``lag`` apart to that lag's matrix."""
    width, codes = layout.width, layout.codes
    out = total[lag * width : (lag + 1) * width]
    sides = [(layout.slot(side), k) for side, k in (("home", 2), ("dest", 3))]
    numbers = [np.vstack([np.ones(len(s[0])), s[0], s[1]]) for s in (earlier, later)]
    out[:3, :3] += numbers[0] @ numbers[1].T
    if not codes:
        return
    # Unknown codes are counted in a place of their own and left out.
    for start, k in sides:
        for row in range(3):
            late = np.bincount(later[k] + 1, numbers[0][row], codes + 1)[1:]
            out[row, start : start + codes] += late
            early = np.bincount(earlier[k] + 1, numbers[1][row], codes + 1)[1:]
            out[start : start + codes, row] += early
        for other, m in sides:
            pair = (earlier[k] + 1) * (codes + 1) + later[m] + 1
            both = np.bincount(pair, minlength=(codes + 1) ** 2).reshape(codes + 1, -1)[1:, 1:]
            out[start : start + codes, other : other + codes] += both


def _blocks(steps: DataFrame, rows: int, length: int, block_rows: int) -> DataFrame:
    """Blocks of positions, each led by copies of the ``length`` rows before it."""
    own = F.floor(F.col("rn") / block_rows)
    held = F.when(
        F.col("rn") % block_rows >= block_rows - length, F.array(own, own + 1)
    ).otherwise(F.array(own))
    cores = steps.sparkSession.sparkContext.defaultParallelism
    partitions = max(min(cores, rows // block_rows + 1), math.ceil(rows / ROWS_PER_PARTITION))
    return (
        steps.withColumn("block", F.explode(held))
        .repartition(partitions, "block")
        .sortWithinPartitions("block", "rn")
    )


def lag_products(
    steps: DataFrame, rows: int, codes: int, length: int, block_rows: int = BLOCK_ROWS
) -> np.ndarray:
    """Sums over all rows of step times the step ``lag`` rows later, by lag from 0 to ``length``.

    ``steps``: ``rn``, ``y``, ``duration``, ``home_idx``, ``dest_idx``. Their
    narrow rows are dealt out once by blocks of positions. A pair counts where
    its later row lies in the block itself, so every pair counts once.
    """
    if block_rows < length:
        raise ValueError("a block must be at least as long as a window")
    layout = Layout(codes)

    def add(total: np.ndarray, batches: Iterable[pa.RecordBatch]) -> None:
        tail: list[np.ndarray] = []
        for batch in batches:
            rn, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rn", "block"))
            new = [block, rn // block_rows == block, *_steps(batch)]
            joined = [np.concatenate(pair) for pair in zip(tail, new, strict=True)] if tail else new
            old = len(joined[0]) - len(block)
            block, own, *values = joined
            for lag in range(length + 1):
                late = np.arange(max(old, lag), len(block))
                late = late[own[late] & (block[late] == block[late - lag])]
                if len(late):
                    _add_products(
                        total, layout, lag, [v[late - lag] for v in values], [v[late] for v in values]
                    )
            tail = [c[-length:] for c in joined]

    shape = ((length + 1) * layout.width, layout.width)
    found = summed_matrix(_blocks(steps, rows, length, block_rows), shape, add)
    return found.reshape(length + 1, layout.width, layout.width)


@dataclass(frozen=True)
class WindowGram:
    """Products with the Gram matrix of all windows that have a row after them."""

    products: np.ndarray  # by lag
    partial: np.ndarray  # the windows to leave out, steps beyond the table being zero
    target: np.ndarray  # of each window column with the row after the window
    rows: int

    @classmethod
    def of(cls, products: np.ndarray, first: np.ndarray, last: np.ndarray, rows: int) -> WindowGram:
        """``first`` and ``last``: the table's first and last steps, a window's length of each."""
        length, width = len(products) - 1, products.shape[1]
        partial = np.zeros((2 * length, length, width))
        for k in range(1, length):  # the window before row k: k steps are there
            partial[k - 1, length - k :] = first[:k]
        for k in range(length + 1):  # the window before row n + k
            partial[length - 1 + k, : length - k] = last[k:]
        target = np.zeros((length, width))
        for place in range(length):
            lag = length - place
            target[place] = products[lag][:, 1]
            if place:
                target[place] -= first[:place].T @ first[lag:, 1][:place]
        return cls(products, partial, target, rows)

    @property
    def windows(self) -> int:
        return self.rows - (len(self.products) - 1)

    def times(self, p: np.ndarray) -> np.ndarray:
        length = len(p)
        out = p @ self.products[0].T
        for lag in range(1, length):
            m = self.products[lag]
            out[:-lag] += p[lag:] @ m.T
            out[lag:] += p[:-lag] @ m
        left_out = np.einsum("klf,lf->k", self.partial, p)
        return out - np.einsum("k,klf->lf", left_out, self.partial)

    def diagonal(self) -> np.ndarray:
        full = np.broadcast_to(np.diag(self.products[0]), self.target.shape)
        return full - (self.partial**2).sum(axis=0)

    def sums(self) -> np.ndarray:
        one = np.zeros(self.target.shape)
        one[0, 0] = 1.0
        return self.times(one)


def solve(gram: WindowGram, square: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights by step and place, and the intercept, of the penalized least squares.

    Minimizes half the mean squared error plus half of ``penalty`` over the
    target's spread times the squared weights, each in units of its column's
    spread. ``square`` is the sum of the squared targets. A column that never
    varies has weight 0.
    """
    n = gram.windows
    sums = gram.sums()
    mean, total = sums / n, gram.target[0, 0]
    diagonal = gram.diagonal()
    squares = diagonal - n * mean**2
    live = squares > CONSTANT * np.maximum(diagonal, 1e-300)
    live[:, 0] = False
    spread = np.sqrt(np.where(live, squares, 1.0) / max(n - 1, 1))
    target_spread = math.sqrt(max(square - total**2 / n, 0.0) / max(n - 1, 1))
    weights = np.zeros(mean.shape)
    if target_spread > 0 and live.any():
        ridge = penalty / target_spread

        def times(u: np.ndarray) -> np.ndarray:
            beta = np.where(live, u / spread, 0.0)
            out = gram.times(beta) / n - mean * (mean * beta).sum()
            return np.where(live, out / spread, 0.0) + ridge * u

        right = np.where(live, (gram.target / n - mean * (total / n)) / spread, 0.0)
        weights = np.where(live, _conjugate_gradients(times, right) / spread, 0.0)
    return weights, float(total / n - (weights * mean).sum())


def _conjugate_gradients(times, right: np.ndarray) -> np.ndarray:
    x, r = np.zeros(right.shape), right.copy()
    p, rr = r.copy(), float((r * r).sum())
    stop = TOLERANCE**2 * rr
    for _ in range(MAX_ITERATIONS):
        if rr <= stop:
            return x
        ap = times(p)
        step = rr / float((p * ap).sum())
        x += step * p
        r -= step * ap
        newer = float((r * r).sum())
        p = r + (newer / rr) * p
        rr = newer
    raise RuntimeError(f"the window fit did not converge in {MAX_ITERATIONS} iterations")


def _numbers(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


@dataclass(frozen=True)
class LaggedModel:
    """Weights of ``length`` steps, oldest first, over scaled steps.

    ``weights[step]`` holds 0, then the weights of the total, the duration and
    the home and destination codes.
    """

    weights: np.ndarray
    intercept: float
    labels: tuple[str, ...]
    scaler: MinMax

    @property
    def length(self) -> int:
        return len(self.weights)

    def _codes(self, step: int, side: str) -> np.ndarray:
        start = Layout(len(self.labels)).slot(side)
        return self.weights[step, start : start + len(self.labels)]

    def _step_score(self, step: int, y: str, duration: str, home: str, dest: str) -> str:
        """SQL of one step's share; an unknown country adds nothing."""
        _, w_y, w_duration = self.weights[step, :3].tolist()
        parts = [f"({y}) * {w_y!r}D", f"({duration}) * {w_duration!r}D"]
        if self.labels:
            for side, position in (("home", home), ("dest", dest)):
                values = _numbers(self._codes(step, side))
                parts.append(f"coalesce(get({values}, {position}), 0D)")
        return " + ".join(parts)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``sequence``, the forecast in EUR, to rows with a ``history`` of scaled steps."""
        number = len(self.labels)
        parts = [
            f"s.y * element_at({_numbers(self.weights[:, 1])}, i + 1)",
            f"s.duration * element_at({_numbers(self.weights[:, 2])}, i + 1)",
        ]
        for side in ("home", "dest") if number else ():
            values = np.concatenate([self._codes(k, side) for k in range(self.length)])
            parts.append(f"coalesce(get({_numbers(values)}, i * {number} + s.{side}_idx), 0D)")
        shares = F.expr(f"transform(history, (s, i) -> {' + '.join(parts)})")
        scaled = F.aggregate(shares, F.lit(self.intercept), lambda total, share: total + share)
        return df.withColumn("sequence", self.scaler.restore("y", scaled))

    def constant(self, tail: Sequence[tuple]) -> float:
        """The share of the past steps of a request's window, its newest step aside."""
        past = list(tail)[-(self.length - 1) :] if self.length > 1 else []
        layout = Layout(len(self.labels))
        total = self.intercept
        for k, (y, duration, home, dest) in enumerate(past):
            codes = [np.array([-1 if c is None else c]) for c in (home, dest)]
            total += float(layout.dense([y], [duration], *codes)[0] @ self.weights[k])
        return total

    def forecast(self, future: DataFrame, tail: Sequence[tuple]) -> DataFrame:
        """Adds ``sequence`` to requests: a constant plus the request's own step.

        The past steps are the same for every request, so their share is worked
        out once; what is left is arithmetic and two lookups by country.
        """
        score = self._step_score(self.length - 1, "w_y", "w_duration", "home_idx", "dest_idx")
        step = future.withColumns(
            {
                "w_y": self.scaler.scale("y", F.lit(0.0)),
                "w_duration": self.scaler.scale("duration", F.col("duration")).cast("double"),
            }
        )
        scaled = F.lit(self.constant(tail)) + F.expr(score)
        sequence: Column = self.scaler.restore("y", scaled).alias("sequence")
        return step.select(*future.columns, sequence)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(-1, [self.intercept])]
        rows += [(k, [float(v) for v in row]) for k, row in enumerate(self.weights)]
        return spark.createDataFrame(rows, "step int, weights array<double>")

    @classmethod
    def from_table(cls, table: DataFrame, labels: Sequence[str], scaler: MinMax) -> LaggedModel:
        rows = {r["step"]: r["weights"] for r in table.collect()}
        intercept = rows.pop(-1)[0]
        weights = np.array([rows[k] for k in sorted(rows)])
        return cls(weights, intercept, tuple(labels), scaler)


def _edge(rows: list, layout: Layout) -> np.ndarray:
    columns = zip(*rows, strict=True)
    y, duration, home, dest = (np.array([np.nan if v is None else v for v in c], float) for c in columns)
    codes = (np.where(np.isnan(c), -1, c).astype(np.int64) for c in (home, dest))
    return layout.dense(y, duration, *codes)


def fit_lagged(
    train: DataFrame,
    rows: int,
    labels: Sequence[str],
    scaler: MinMax,
    length: int = SEQUENCE_LENGTH,
    penalty: float = PENALTY,
    block_rows: int = BLOCK_ROWS,
) -> LaggedModel | None:
    """Fit on every full window of the ranked training rows; None below one window.

    The result is that of a linear regression on the windows' vectors with the
    same penalty, up to rounding.
    """
    if rows <= length:
        return None
    steps = train.select(
        "rn",
        scaler.scale("y", F.col("y")).cast("double").alias("y"),
        scaler.scale("duration", F.col("duration")).cast("double").alias("duration"),
        "home_idx",
        "dest_idx",
    )
    layout = Layout(len(labels))
    edges = steps.filter((F.col("rn") < length) | (F.col("rn") >= rows - length)).collect()
    by_rank = {r["rn"]: tuple(r)[1:] for r in edges}
    first = _edge([by_rank[k] for k in range(length)], layout)
    last = _edge([by_rank[k] for k in range(rows - length, rows)], layout)
    products = lag_products(steps, rows, len(labels), length, block_rows)
    gram = WindowGram.of(products, first, last, rows)
    square = products[0][1, 1] - float((first[:, 1] ** 2).sum())
    weights, intercept = solve(gram, square, penalty)
    return LaggedModel(weights, intercept, tuple(labels), scaler)
