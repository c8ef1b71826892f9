import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import planted_trips
from tripledger.models.additive import Settings, fit_additive
from tripledger.models.origins import even_origins, evaluate_origins, fit_origins, predict_origins
from tripledger.operators.ranks import train_size
from tripledger.plans.trips import rank_trips

CODES = ["AA", "BB", "CC", "DD"]


@pytest.fixture(scope="module")
def ranked(spark):
    return rank_trips(planted_trips(spark, 400), CODES)


@pytest.mark.parametrize("settings", [Settings(), Settings(sparse_trend=False), Settings(changepoints=3, seasons=())])
def test_each_origin_equals_a_fit_of_its_own(ranked, settings):
    origins = [60, 150, 320]
    models = fit_origins(ranked, origins, CODES, settings)
    for origin, model in zip(origins, models, strict=True):
        alone = fit_additive(ranked.before(origin), CODES, settings)
        assert model.design.calendar == alone.design.calendar
        assert model.design.mean == pytest.approx(alone.design.mean)
        both = alone.transform(model.transform(ranked.rows).withColumnRenamed("additive", "ours")).collect()
        assert [r.ours for r in both] == pytest.approx([r.additive for r in both], rel=1e-5, abs=1e-3)


def test_errors_by_origin_and_every_trip_once(ranked):
    origins = even_origins(ranked.count, 4)
    assert origins[-1] == train_size(ranked.count) and len(origins) == 4
    models = fit_origins(ranked, origins, CODES)
    scored = predict_origins(ranked, origins, models).collect()
    assert sorted(r.rn for r in scored) == list(range(origins[0], ranked.count))
    got = {r.origin: r for r in evaluate_origins(ranked, origins, CODES).collect()}
    for k, origin in enumerate(origins):
        mine = [r for r in scored if r.origin == origin]
        assert {r.rn for r in mine} == set(range(origin, [*origins[1:], ranked.count][k]))
        assert got[origin].rmse == pytest.approx(np.sqrt(np.mean([(r.y - r.additive) ** 2 for r in mine])))
        assert got[origin].trips == len(mine)
    # The last origin is the hold-out of the additive part.
    alone = fit_additive(ranked.before(origins[-1]), CODES).transform(ranked.since(origins[-1]))
    want = alone.agg(F.sqrt(F.avg((F.col("y") - F.col("additive")) ** 2))).first()[0]
    assert got[origins[-1]].rmse == pytest.approx(want, rel=1e-4)


def test_wrong_origins_are_refused(ranked):
    for wrong in ([], [50, 40], [10, 401], [30, 30]):
        with pytest.raises(ValueError):
            fit_origins(ranked, wrong, CODES)
