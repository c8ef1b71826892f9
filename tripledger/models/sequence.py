"""Sequence forecaster on written windows: 60 scaled steps in, the next scaled total out.

The learner is any ``pyspark.ml`` regressor. The default of a hybrid, a linear
learner, needs no windows and lies in ``models.lagged``; a linear regressor on
the windows of this module gives the same weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tripledger.models.additive import sql_double
from tripledger.operators.encode import declared_size
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import SEQUENCE_LENGTH, request_window, step, with_history


#: A fit that needs more iterations than this is an error; the tolerance ends it before.
MAX_ITERATIONS = 1_000


def default_regressor(max_iter: int = MAX_ITERATIONS, tol: float = 1e-6) -> LinearRegression:
    """A linear learner that iterates until its relative change is below ``tol``."""
    return LinearRegression(solver="l-bfgs", regParam=0.01, maxIter=max_iter, tol=tol)


def check_converged(model) -> None:
    """A linear fit that its iteration limit has ended is not a result."""
    if isinstance(model, LinearRegressionModel) and model.hasSummary:
        used, most = model.summary.totalIterations, model.getOrDefault(model.maxIter)
        if used >= most:
            raise RuntimeError(f"the sequence fit did not converge in {most} iterations")


def scaled_step(scaler: MinMax) -> Column:
    return step(
        scaler.scale("y", F.col("y")),
        scaler.scale("duration", F.col("duration")),
        F.col("home_idx"),
        F.col("dest_idx"),
    )


def _tail_literal(tail: Sequence[tuple]) -> Column:
    """The steps as one constant array, written as SQL text to keep planning short."""
    steps = (
        f"struct({sql_double(y)} AS y, {sql_double(duration)} AS duration, "
        f"CAST({'NULL' if home is None else home} AS INT) AS home_idx, "
        f"CAST({'NULL' if dest is None else dest} AS INT) AS dest_idx)"
        for y, duration, home, dest in tail
    )
    return F.expr(f"array({', '.join(steps)})")


def with_request_window(future: DataFrame, tail: Sequence[tuple], scaler: MinMax) -> DataFrame:
    """All but the oldest of the last training steps, then the request with a total of 0."""
    newest = step(
        scaler.scale("y", F.lit(0.0)),
        scaler.scale("duration", F.col("duration")),
        F.col("home_idx"),
        F.col("dest_idx"),
    )
    return future.withColumn("history", request_window(_tail_literal(tail[1:]), newest))


def vector_size(labels: Sequence[str], length: int = SEQUENCE_LENGTH) -> int:
    return 2 * length * (1 + len(labels))


def window_vector(labels: Sequence[str], scaler: MinMax, length: int = SEQUENCE_LENGTH) -> Column:
    """The array ``history`` as one sparse vector.

    Its slots are the totals, the durations, then one home and one destination
    group per step. Spark has no built-in that makes a sparse vector from
    positions, so whole Arrow batches go through numpy. A country outside the
    domain has no slot; a one-hot column that is 1 in all training rows scales
    to 0 and is left empty.
    """
    width = len(labels)
    size = vector_size(labels, length)
    live = {
        side: np.array([k not in scaler.always_on(side, labels) for k in range(width)] + [False])
        for side in ("home", "dest")
    }
    steps = np.arange(length)
    first = {"home": 2 * length + steps * width, "dest": (2 + width) * length + steps * width}

    @arrow_udf(VectorUDT())
    def vectorize(history: pa.Array) -> pa.Array:
        rows, flat = len(history), history.flatten()

        def matrix(field: str) -> np.ndarray:
            values = flat.field(field)
            if field.endswith("_idx"):
                values = values.fill_null(-1)
            return values.to_numpy(zero_copy_only=False).reshape(rows, length)

        numbers = np.hstack([matrix("y"), matrix("duration")])
        slots, used = [np.tile(np.arange(2 * length), (rows, 1))], [np.ones_like(numbers, bool)]
        for side in ("home", "dest"):
            if not width:  # an empty domain has no slots
                break
            position = matrix(f"{side}_idx")
            slots.append(first[side] + position)
            used.append(live[side][position])
        keep = np.hstack(used)
        values = np.hstack([numbers, np.ones((rows, keep.shape[1] - 2 * length))])[keep]
        ends = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(rows, np.int8)),
                pa.array(np.full(rows, size, np.int32)),
                pa.ListArray.from_arrays(ends, np.hstack(slots)[keep].astype(np.int32)),
                pa.ListArray.from_arrays(ends, values),
            ],
            names=["type", "size", "indices", "values"],
        )

    return vectorize("history")


@dataclass(frozen=True)
class SequenceModel:
    """A fitted regressor and the domain and scaling of its windows."""

    pipeline: PipelineModel
    labels: tuple[str, ...]
    scaler: MinMax

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``sequence``, the forecast in EUR, to rows with a ``history``."""
        features = df.withColumn("w_features", window_vector(self.labels, self.scaler))
        sequence = self.scaler.restore("y", F.col("w_prediction"))
        return self.pipeline.transform(features).select(*df.columns, sequence.alias("sequence"))

    def forecast(self, future: DataFrame, tail: Sequence[tuple]) -> DataFrame:
        """Adds ``sequence`` to requests; each gets the window it ends."""
        windows = with_request_window(future, tail, self.scaler)
        return self.transform(windows).drop("history")


def fit_sequence(
    train: DataFrame,
    rows: int,
    labels: Sequence[str],
    scaler: MinMax,
    regressor: Estimator | None = None,
    length: int = SEQUENCE_LENGTH,
) -> SequenceModel | None:
    """Fit on every full window of the ranked training rows; None below one window."""
    if rows <= length:
        return None
    base = regressor or default_regressor()
    learner = base.copy(
        {
            base.getParam("featuresCol"): "w_features",
            base.getParam("labelCol"): "w_target",
            base.getParam("predictionCol"): "w_prediction",
        }
    )
    windows = with_history(train, scaled_step(scaler), rows, length).select(
        window_vector(labels, scaler, length).alias("w_features"),
        scaler.scale("y", F.col("y")).alias("w_target"),
    )
    sized = declared_size("w_features", vector_size(labels, length)).transform(windows)
    fitted = learner.fit(sized)
    check_converged(fitted)
    return SequenceModel(PipelineModel([fitted]), tuple(labels), scaler)
