"""The training job: trips, ordered split, fit, evaluation, bundle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.models.additive import Settings
from tripledger.models.bundle import save
from tripledger.models.hybrid import HybridModel, evaluate, fit_hybrid
from tripledger.models.lagged import PENALTY
from tripledger.models.recurrent import Reservoir
from tripledger.operators.encode import domain_of
from tripledger.operators.ranks import Ranked, train_size
from tripledger.operators.windows import SEQUENCE_LENGTH
from tripledger.plans.trips import build_trips, rank_trips


@dataclass(frozen=True)
class Training:
    model: HybridModel
    metrics: DataFrame
    ranked: Ranked


def run_training(
    lines: DataFrame,
    rates: DataFrame,
    countries: DataFrame,
    bundle_path: str | None = None,
    order_by: Sequence[str] = ("report_key",),
    test_fraction: float = 0.2,
    regressor: Estimator | Reservoir | None = None,
    settings: Settings = Settings(),
    with_sequence: bool = True,
    length: int = SEQUENCE_LENGTH,
    penalty: float = PENALTY,
) -> Training:
    """Train on the first trips in order, hold out the rest, save if asked."""
    labels = domain_of(countries)
    ranked = rank_trips(build_trips(lines, rates), labels, order_by)
    rows = train_size(ranked.count, test_fraction)
    train = ranked.before(rows)
    recent = ranked.since(max(rows - length, 0)).filter(F.col("rn") < rows)
    model = fit_hybrid(
        train, rows, labels, regressor, settings, with_sequence, recent, length, penalty
    )
    if bundle_path is not None:
        model = save(model, bundle_path)
    return Training(model, evaluate(model, ranked), ranked)
