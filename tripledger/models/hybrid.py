"""The hybrid of both forecasters, its forecasts and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripledger.functions.trip import request_day
from tripledger.models.additive import AdditiveModel, Settings, fit_additive
from tripledger.models.lagged import PENALTY, LaggedModel, fit_lagged
from tripledger.models.recurrent import RecurrentModel, Reservoir, fit_recurrent
from tripledger.models.sequence import (
    SequenceModel,
    fit_sequence,
    scaled_step,
    with_request_window,
)
from tripledger.operators.encode import with_category_index
from tripledger.operators.metrics import (
    breakdown,
    category_shares,
    error_metrics,
    hybrid_average,
)
from tripledger.operators.ranks import Ranked, history_tail
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import SEQUENCE_LENGTH, STEP_FIELDS, with_history

__all__ = [
    "HybridModel", "evaluate", "fit_hybrid", "forecast", "future_rows", "is_complete",
    "predict_hold_out", "tail_steps", "with_request_window",
]


@dataclass(frozen=True)
class HybridModel:
    """Everything a forecast needs; ``train`` is the snapshot it was fitted on."""

    additive: AdditiveModel
    sequence: SequenceModel | LaggedModel | RecurrentModel | None
    scaler: MinMax
    labels: tuple[str, ...]
    shares: dict[str, float | None]
    tail: tuple[tuple, ...]
    train: DataFrame
    train_rows: int
    length: int = SEQUENCE_LENGTH


def tail_steps(train: DataFrame, scaler: MinMax, length: int = SEQUENCE_LENGTH) -> tuple[tuple, ...]:
    """Scaled steps of the last training trips, oldest first; at most ``length``."""
    last = history_tail(train, length).select("rn", scaled_step(scaler).alias("step")).collect()
    return tuple(
        tuple(row["step"][f] for f in STEP_FIELDS) for row in sorted(last, key=lambda r: r["rn"])
    )


def fit_hybrid(
    train: DataFrame,
    rows: int,
    labels: Sequence[str],
    regressor: Estimator | Reservoir | None = None,
    settings: Settings = Settings(),
    with_sequence: bool = True,
    recent: DataFrame | None = None,
    length: int = SEQUENCE_LENGTH,
    penalty: float = PENALTY,
) -> HybridModel:
    """Fit both forecasters on ranked, encoded training trips with a known total.

    ``regressor`` learns from written windows; a ``Reservoir`` makes it the
    recurrent learner and without one the linear learner with this ``penalty`` is
    fitted, both of which need none. ``length`` is the number
    of steps of a window. ``recent``: the last of these trips, where the caller
    can read them alone.

    With too few trips for one window, or on request, the hybrid has the
    additive part only.
    """
    scaler = MinMax.fit(train, labels)
    sequence = None
    if with_sequence and regressor is None:
        sequence = fit_lagged(train, rows, labels, scaler, length, penalty)
    elif with_sequence and isinstance(regressor, Reservoir):
        sequence = fit_recurrent(train, rows, labels, scaler, regressor, length)
    elif with_sequence:
        sequence = fit_sequence(train, rows, labels, scaler, regressor, length)
    return HybridModel(
        additive=fit_additive(train, labels, settings),
        sequence=sequence,
        scaler=scaler,
        labels=tuple(labels),
        shares=category_shares(train).first().asDict(),
        tail=tail_steps(train if recent is None else recent, scaler, length),
        train=train,
        train_rows=rows,
        length=length,
    )


def predict_hold_out(model: HybridModel, ranked: Ranked) -> DataFrame:
    """Predictions for the trips after the training rows.

    Windows are one step ahead: later ones hold the true totals of earlier
    hold-out trips. A row carries the inputs of both forecasters, so their
    predictions need no join.
    """
    first = model.train_rows
    if model.sequence is None:
        rows = model.additive.transform(ranked.since(first))
        return rows.withColumn("sequence", F.lit(0.0)).withColumn("predicted", F.col("additive"))
    context = ranked.since(first - model.length)
    windows = with_history(
        context, scaled_step(model.scaler), ranked.count - first + model.length, model.length
    ).filter(F.col("rn") >= first)
    return (
        model.sequence.transform(model.additive.transform(windows))
        .drop("history")
        .withColumn("predicted", hybrid_average(F.col("additive"), F.col("sequence")))
    )


def evaluate(model: HybridModel, ranked: Ranked) -> DataFrame:
    """One row ``rmse, mse`` over the hold-out."""
    return error_metrics(predict_hold_out(model, ranked), "y", "predicted")


def is_complete() -> Column:
    """Whether a request names a month that exists and a number of days."""
    return request_day(F.col("year"), F.col("month")).isNotNull() & F.col("num_days").isNotNull()


def future_rows(requests: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Requests as model input; the number of days is taken as given."""
    dated = requests.withColumn("ds", request_day(F.col("year"), F.col("month"))).withColumn(
        "duration", F.col("num_days")
    )
    return with_category_index(dated, labels)


def forecast(model: HybridModel, requests: DataFrame) -> DataFrame:
    """Total, both component values and the cost breakdown for every request.

    Projections only: no shuffle, no join, no state and, with the default
    learners, no Python, so the same plan serves a table and a stream. A request without a usable day or
    number of days comes back with nulls and does not disturb the others.
    """
    usable = is_complete()
    given = future_rows(requests.withColumn("usable", usable), model.labels)
    whole = given.withColumn(
        "ds", F.coalesce("ds", F.date_from_unix_date(F.lit(model.additive.design.calendar.first_day)))
    ).withColumn("duration", F.coalesce("duration", F.lit(1)))
    rows = model.additive.transform(whole)
    if model.sequence is None:
        rows = rows.withColumn("sequence", F.lit(0.0)).withColumn("total", F.col("additive"))
    else:
        rows = model.sequence.forecast(rows, model.tail).withColumn(
            "total", hybrid_average(F.col("additive"), F.col("sequence"))
        )
    kept = [F.when(F.col("usable"), F.col(c)).alias(c) for c in ("total", "additive", "sequence")]
    split = F.when(F.col("usable"), breakdown(F.col("total"), model.shares))
    return rows.select(*requests.columns, *kept, split.alias("breakdown"))
