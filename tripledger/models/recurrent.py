"""Recurrent window learner: a fixed random recurrent state, a trained read-out.

Each of a window's steps moves a state: its units are the tanh of random weights
of the step and of the state before (an echo state network, after Jaeger, 2001).
The last state and the last step are the features of a ridge regression, whose
normal equations are added up in one pass. Nothing but the read-out is trained, so
the fit has no epochs and no gradient, and a seed fixes its result.

Windows are not written: a block of ranked rows holds them all, and the states of
all windows of a batch take a step together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tripledger.models.lagged import BLOCK_ROWS, Layout, _blocks, _steps
from tripledger.models.sequence import with_request_window
from tripledger.operators.gram import summed_matrix
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import SEQUENCE_LENGTH

#: Windows whose states a task holds at once; one step of all of them is some 3 MB.
WINDOWS = 4096


@dataclass(frozen=True)
class Reservoir:
    """Settings of the random state; ``memory`` is the spectral radius of its weights."""

    units: int = 96
    memory: float = 0.8
    inputs: float = 1.0
    penalty: float = 1e-6
    seed: int = 7

    def draw(self, codes: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of a step's places (the one first) and of the state before."""
        rng = np.random.default_rng(self.seed)
        step = rng.uniform(-self.inputs, self.inputs, (Layout(codes).width, self.units))
        state = rng.normal(size=(self.units, self.units))
        radius = np.abs(np.linalg.eigvals(state)).max(initial=0.0)
        return step, state * (self.memory / (radius or 1.0))


def _inputs(step: np.ndarray, codes: int, y, duration, home, dest) -> np.ndarray:
    """What each step adds to the units; a country outside the domain adds nothing."""
    out = step[0] + np.outer(y, step[1]) + np.outer(duration, step[2])
    layout = Layout(codes)
    for side, position in (("home", home), ("dest", dest)):
        known = np.flatnonzero((position >= 0) & (position < codes))
        out[known] += step[layout.slot(side) + position[known]]
    return out


def _features(inputs: Callable, first: np.ndarray, length: int, state: np.ndarray, last) -> np.ndarray:
    """A one, the last state and the last step's numbers of the windows that begin at ``first``.

    ``inputs`` gives the inputs of the rows it is asked for.
    """
    h = np.zeros((len(first), len(state)))
    for k in range(length):
        h = np.tanh(inputs(first + k) + h @ state)
    numbers = [column[first + length - 1] for column in last]
    return np.column_stack([np.ones(len(first)), h, *numbers])


@dataclass(frozen=True)
class RecurrentModel:
    """The drawn weights, and the read-out: intercept, units, the last total and duration."""

    step: np.ndarray
    state: np.ndarray
    read_out: np.ndarray
    length: int
    labels: tuple[str, ...]
    scaler: MinMax

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``sequence``, the forecast in EUR, to rows with a ``history`` of scaled steps."""
        step, state, read_out, length = self.step, self.state, self.read_out, self.length
        codes = len(self.labels)

        @arrow_udf("double")
        def score(history: pa.Array) -> pa.Array:
            flat = history.flatten()
            columns = {
                name: flat.field(name).fill_null(-1).to_numpy(zero_copy_only=False)
                for name in ("y", "duration", "home_idx", "dest_idx")
            }
            values = tuple(columns.values())

            def inputs(at: np.ndarray) -> np.ndarray:
                # A batch holds many more steps than windows: never the inputs of all.
                return _inputs(step, codes, *(v[at] for v in values))

            out = []
            for at in range(0, len(history), WINDOWS):
                first = np.arange(at, min(at + WINDOWS, len(history))) * length
                last = (columns["y"], columns["duration"])
                out.append(_features(inputs, first, length, state, last) @ read_out)
            return pa.array(np.concatenate([*out, np.zeros(0)]))

        return df.withColumn("sequence", self.scaler.restore("y", score("history")))

    def forecast(self, future: DataFrame, tail: Sequence[tuple]) -> DataFrame:
        """Adds ``sequence`` to requests; each gets the window it ends."""
        return self.transform(with_request_window(future, tail, self.scaler)).drop("history")

    def table(self, spark: SparkSession) -> DataFrame:
        parts = {"step": self.step, "state": self.state, "read_out": self.read_out[None, :]}
        rows = [
            (name, k, [float(v) for v in row]) for name, m in parts.items() for k, row in enumerate(m)
        ]
        return spark.createDataFrame(
            [("length", self.length, []), *rows], "part string, row int, weights array<double>"
        )

    @classmethod
    def from_table(cls, table: DataFrame, labels: Sequence[str], scaler: MinMax) -> RecurrentModel:
        rows = sorted((r["part"], r["row"], r["weights"]) for r in table.collect())

        def part(name: str) -> np.ndarray:
            return np.array([w for p, _, w in rows if p == name])

        length = next(k for p, k, _ in rows if p == "length")
        return cls(part("step"), part("state"), part("read_out")[0], length, tuple(labels), scaler)


def fit_recurrent(
    train: DataFrame,
    rows: int,
    labels: Sequence[str],
    scaler: MinMax,
    reservoir: Reservoir = Reservoir(),
    length: int = SEQUENCE_LENGTH,
    block_rows: int = BLOCK_ROWS,
) -> RecurrentModel | None:
    """Fit the read-out on every full window of the ranked rows; None below one window.

    The driver gets one Gram matrix of the features and the target.
    """
    if rows <= length:
        return None
    codes = len(labels)
    step, state = reservoir.draw(codes)
    size = reservoir.units + 4

    def add(total: np.ndarray, batches: Iterable[pa.RecordBatch]) -> None:
        tail: list[np.ndarray] = []
        for batch in batches:
            rn, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rn", "block"))
            new = [block, rn // block_rows == block, *_steps(batch)]
            joined = [np.concatenate(pair) for pair in zip(tail, new, strict=True)] if tail else new
            old = len(joined[0]) - len(block)
            block, own, *values = joined
            # Rows that a whole window of their block precedes.
            after = np.arange(max(old, length), len(block))
            after = after[own[after] & (block[after] == block[after - length])]
            inputs = _inputs(step, codes, *values)
            for at in range(0, len(after), WINDOWS):
                some = after[at : at + WINDOWS]
                x = _features(inputs.__getitem__, some - length, length, state, values[:2])
                whole = np.column_stack([x, values[0][some]])
                total += whole.T @ whole
            tail = [c[-length:] for c in joined]

    steps = train.select(
        "rn",
        scaler.scale("y", F.col("y")).cast("double").alias("y"),
        scaler.scale("duration", F.col("duration")).cast("double").alias("duration"),
        "home_idx",
        "dest_idx",
    )
    gram = summed_matrix(_blocks(steps, rows, length, block_rows), (size, size), add)
    n = gram[0, 0]
    mean, target = gram[0, 1:-1] / n, gram[0, -1] / n
    products = gram[1:-1, 1:-1] / n - np.outer(mean, mean)
    right = gram[1:-1, -1] / n - mean * target
    weights = np.linalg.solve(products + reservoir.penalty * np.eye(len(mean)), right)
    read_out = np.concatenate([[target - mean @ weights], weights])
    return RecurrentModel(step, state, read_out, length, tuple(labels), scaler)
