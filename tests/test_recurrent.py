import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fixtures import planted_trips
from tripledger.models import bundle, hybrid, recurrent
from tripledger.models.lagged import fit_lagged
from tripledger.models.recurrent import Reservoir, fit_recurrent
from tripledger.models.sequence import scaled_step
from tripledger.operators.ranks import rank_rows
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import with_history
from tripledger.plans.trips import rank_trips
from tripledger.schemas import REQUEST
from tripledger.session import scratch_path

KIND = "id long, y double, duration int, home_idx int, dest_idx int"


def chaotic(spark, rows=900):
    """Totals that follow the former one by a parabola; a line through them is flat."""
    y, out = 0.3, []
    for k in range(rows):
        out.append((k, 1000 * y, 1 + k % 3, k % 2, None))
        y = 3.9 * y * (1 - y)
    return rank_rows(spark.createDataFrame(out, KIND), "id")


def errors(ranked, model, scaler, length):
    found = with_history(ranked.rows, scaled_step(scaler), ranked.count, length, 512).filter("rn >= 700")
    scored = model.transform(found)
    return scored.agg(F.sqrt(F.avg((F.col("y") - F.col("sequence")) ** 2))).first()[0]


def test_it_beats_the_linear_learner_where_lines_do_not_help(spark):
    ranked = chaotic(spark)
    train = ranked.before(700)
    scaler = MinMax.fit(train, ["AA", "BB"])
    linear = fit_lagged(train, 700, ["AA", "BB"], scaler, 10)
    recurrent = fit_recurrent(train, 700, ["AA", "BB"], scaler, length=10)
    assert errors(ranked, recurrent, scaler, 10) < 0.2 * errors(ranked, linear, scaler, 10)


@pytest.mark.parametrize("length, block", [(7, 9), (7, 1000), (60, 64)])
def test_read_out_equals_the_regression_on_states_by_loops(spark, length, block):
    labels, settings = ["AA", "BB"], Reservoir(units=8, penalty=1e-4)
    ranked = chaotic(spark, 300)
    scaler = MinMax.fit(ranked.rows, labels)
    model = fit_recurrent(ranked.rows, 300, labels, scaler, settings, length, block)
    rows = ranked.rows.orderBy("rn").select(scaled_step(scaler).alias("s")).collect()
    steps = []
    for r in rows:
        s = [1.0, r.s.y, r.s.duration] + [0.0] * 4
        for offset, position in ((3, r.s.home_idx), (5, r.s.dest_idx)):
            if position is not None:
                s[offset + position] = 1.0
        steps.append(s)
    steps = np.array(steps)
    x, z = [], []
    for i in range(length, 300):
        h = np.zeros(8)
        for s in steps[i - length : i]:
            h = np.tanh(s @ model.step + h @ model.state)
        x.append([*h, steps[i - 1, 1], steps[i - 1, 2]])
        z.append(steps[i, 1])
    x, z = np.array(x), np.array(z)
    xc, zc = x - x.mean(0), z - z.mean()
    want = np.linalg.solve(xc.T @ xc / len(z) + 1e-4 * np.eye(10), xc.T @ zc / len(z))
    assert model.read_out[1:] == pytest.approx(want, abs=1e-8)
    found = with_history(ranked.rows, scaled_step(scaler), 300, length, 512)
    got = [r.sequence for r in model.transform(found).orderBy("rn").collect()]
    low, high = scaler.bounds["y"]
    direct = (x @ model.read_out[1:] + model.read_out[0]) * (high - low) + low
    assert got == pytest.approx(direct, rel=1e-9)
    again = fit_recurrent(ranked.rows, 300, labels, scaler, settings, length, block)
    assert (again.state == model.state).all() and again.read_out == pytest.approx(model.read_out, abs=1e-10)


def test_hybrid_with_a_recurrent_part_is_saved_and_forecasts(spark):
    codes = ["AA", "BB", "CC", "DD"]
    ranked = rank_trips(planted_trips(spark, 200), codes)
    model = hybrid.fit_hybrid(ranked.before(160), 160, codes, regressor=Reservoir(units=12))
    requests = spark.createDataFrame([("AA", "BB", 5, 3, 2021), ("ZZ", None, 0, 12, None)], REQUEST)
    want = hybrid.forecast(model, requests).collect()
    assert all(np.isfinite(r.sequence) and r.total == pytest.approx((r.additive + r.sequence) / 2) for r in want)
    path = scratch_path(spark, "bundle")
    bundle.save(model, path)
    assert hybrid.forecast(bundle.load(spark, path), requests).collect() == want
    assert hybrid.evaluate(model, ranked).first().rmse > 0


def test_a_batch_is_scored_without_the_inputs_of_all_its_steps(spark, monkeypatch):
    """A task holds the inputs of one step of ``WINDOWS`` windows, however many a batch has."""
    monkeypatch.setattr(recurrent, "WINDOWS", 50)
    wanted = []
    inputs = recurrent._inputs
    monkeypatch.setattr(
        recurrent, "_inputs", lambda *a: wanted.append(len(a[2])) or inputs(*a)
    )
    monkeypatch.setattr(recurrent, "arrow_udf", lambda kind: lambda score: wanted_of(score))
    batch = pa.array(
        [[{"y": 0.1 * k, "duration": 0.2, "home_idx": k % 2, "dest_idx": None}] * 10 for k in range(230)],
        pa.list_(pa.struct([("y", pa.float64()), ("duration", pa.float64()), ("home_idx", pa.int32()), ("dest_idx", pa.int32())])),
    )

    def wanted_of(score):
        assert len(score(batch)) == 230
        return lambda column: F.lit(0.0)

    step, state = Reservoir(units=4).draw(2)
    scaler = MinMax.fit(chaotic(spark, 80).rows, ["AA", "BB"])
    model = recurrent.RecurrentModel(step, state, np.ones(7), 10, ("AA", "BB"), scaler)
    model.transform(spark.range(1).withColumn("history", F.lit(0)))
    assert wanted and max(wanted) <= 50


def test_without_countries_and_with_too_few_rows(spark):
    ranked = chaotic(spark, 80)
    scaler = MinMax.fit(ranked.rows, [])
    assert fit_recurrent(ranked.rows, 80, [], scaler, length=80) is None
    model = fit_recurrent(ranked.rows, 80, [], scaler, Reservoir(units=4), 5)
    assert np.isfinite(errors(rank_rows(ranked.rows.drop("rn"), "id"), model, scaler, 5) or 0.0)
