import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from fixtures import planted_trips
from tripledger.models import additive, bundle, hybrid
from tripledger.models.hybrid import evaluate, fit_hybrid, forecast
from tripledger.models.sequence import (
    default_regressor,
    fit_sequence,
    scaled_step,
    window_vector,
)
from tripledger.operators.ranks import train_size
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import with_history
from tripledger.plans.trips import rank_trips
from tripledger.schemas import REQUEST
from tripledger.session import Scratch, scratch_path, shared_dir
from tripledger.streaming.scoring import reject_stream, score_stream

CODES = ["AA", "BB", "CC", "DD"]


@pytest.fixture(scope="module")
def ranked(spark):
    return rank_trips(planted_trips(spark, 400), CODES)


@pytest.fixture(scope="module")
def model(ranked):
    rows = train_size(ranked.count)
    return fit_hybrid(ranked.rows.filter(F.col("rn") < rows), rows, CODES)


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(
        [("AA", "BB", 5, 3, 2021), ("ZZ", None, 0, 12, None), ("DD", "CC", 40, 7, 2031)], REQUEST
    )


def design_of(train, labels, settings):
    """The design matrix and target of a fit, written out here."""
    model = additive.fit_additive(train, labels, settings)
    design = model.design
    numbers = [F.expr(v).alias(n) for n, v, _ in design.numeric()]
    flags = [F.coalesce((F.col(f"{s}_country") == c).cast("double"), F.lit(0.0)).alias(f"{s}_{c}")
             for s in ("home", "dest") for c in labels]
    rows = train.select(*numbers, *flags, F.col("y") / design.y_scale).collect()
    matrix = np.array([tuple(r) for r in rows], float)
    return model, matrix[:, :-1], matrix[:, -1]


def test_gram_pass_and_ridge_equal_the_written_design(ranked):
    model, x, y = design_of(ranked.rows, CODES, additive.Settings(sparse_trend=False))
    gram = model.design.gram(ranked.rows)
    whole = np.column_stack([np.ones(len(y)), x, y])
    assert gram == pytest.approx(whole.T @ whole, rel=1e-9, abs=1e-9)
    xc, yc = x - x.mean(0), y - y.mean()
    priors = np.array(model.design.priors())
    first = np.linalg.solve(xc.T @ xc + np.diag(additive.SLIGHT / priors**2), xc.T @ yc)
    noise = np.mean((yc - xc @ first) ** 2)
    want = np.linalg.solve(xc.T @ xc + np.diag(noise / priors**2), xc.T @ yc)
    # All codes of a side shifted against the intercept differ in the tiny penalty alone.
    assert np.array(model.weights) == pytest.approx(want, abs=1e-3)
    assert xc @ np.array(model.weights) == pytest.approx(xc @ want, abs=1e-8)
    assert model.intercept + x.mean(0) @ np.array(model.weights) == pytest.approx(y.mean(), abs=1e-9)
    fitted = model.transform(ranked.rows).orderBy("rn").select("additive").collect()
    order = ranked.rows.select("rn").collect()
    direct = (x @ np.array(model.weights) + model.intercept) * model.design.y_scale
    assert [r.additive for r in fitted] == pytest.approx(direct[np.argsort([r.rn for r in order])])


def test_trend_changes_meet_the_conditions_of_their_laplace_prior(ranked):
    model, x, y = design_of(ranked.rows, CODES, additive.Settings())
    xc, yc = x - x.mean(0), y - y.mean()
    priors, beta = np.array(model.design.priors()), np.array(model.weights)
    first = np.linalg.solve(xc.T @ xc + np.diag(additive.SLIGHT / priors**2), xc.T @ yc)
    noise = np.mean((yc - xc @ first) ** 2)
    slope = xc.T @ (yc - xc @ beta)
    hinge = np.array([n.startswith("hinge") for n in model.design.column_names()])
    room = 1e-5 * noise / additive.CHANGEPOINT_PRIOR + 1e-9
    assert slope[~hinge] == pytest.approx((noise / priors**2 * beta)[~hinge], abs=1e-7)
    zero = hinge & (beta == 0)
    assert zero.any()
    assert (np.abs(slope[zero]) <= noise / additive.CHANGEPOINT_PRIOR + room).all()
    there = hinge & (beta != 0)
    assert slope[there] == pytest.approx(np.sign(beta[there]) * noise / additive.CHANGEPOINT_PRIOR, abs=room)


def test_lasso_at_its_limits_and_against_a_grid():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 6))
    x[:, 3] = x[:, 2] + 0.01 * rng.normal(size=200)  # nearly the same column twice
    y = x @ [2.0, 0.0, 1.0, 0.0, -0.5, 0.0] + 0.1 * rng.normal(size=200)
    p, r = x.T @ x, x.T @ y
    none, much = np.zeros(6), np.full(6, 1e9)
    assert additive.lasso(p, r, none) == pytest.approx(np.linalg.solve(p, r), abs=1e-6)
    assert not additive.lasso(p, r, much).any()
    for t in (0.5, 5.0, 40.0):
        found = additive.lasso(p, r, np.full(6, t))
        assert additive.meets_conditions(p, r, np.full(6, t), found)

        def cost(b):
            return b @ p @ b / 2 - r @ b + t * np.abs(b).sum()

        nearby = found + rng.normal(size=(2000, 6)) * np.geomspace(1e-6, 1, 2000)[:, None]
        assert cost(found) <= min(map(cost, nearby)) + 1e-9


def test_a_sharp_change_is_found_among_changepoints_that_do_not_matter(spark):
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    rows = spark.range(1000).select(
        F.col("id").alias("report_key"), day.alias("ds"), F.lit("AA").alias("home_country"),
        F.lit("BB").alias("dest_country"), F.lit(1).alias("duration"),
        (F.col("id") + 9.0 * F.greatest(F.col("id") - 480, F.lit(0)) + F.sin("id") * 20).alias("y"),
    )
    settings = additive.Settings(seasons=())
    sparse = dict(additive.fit_additive(rows, [], settings).coefficients())
    dense = dict(additive.fit_additive(rows, [], additive.Settings(seasons=(), sparse_trend=False)).coefficients())
    hinges = [f"hinge_{j}" for j in range(1, 26)]
    assert sum(sparse[h] != 0 for h in hinges) < 12 < sum(dense[h] != 0 for h in hinges)
    # Changepoints lie 32 days apart; the 15th is day 480.
    assert max(hinges, key=lambda h: abs(sparse[h])) == "hinge_15"


def test_forecast_and_stream_need_no_python(model, requests):
    plan = forecast(model, requests)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_additive_model_recovers_planted_effects(model, ranked):
    effects = dict(model.additive.coefficients())
    scale = model.additive.design.y_scale
    per_day = effects["duration"] * scale / model.additive.design.spread
    assert per_day == pytest.approx(40.0, abs=0.5)
    assert (effects["home_DD"] - effects["home_AA"]) * scale == pytest.approx(300.0, abs=3)
    assert (effects["dest_CC"] - effects["dest_AA"]) * scale == pytest.approx(-120.0, abs=3)
    held_out = model.additive.transform(ranked.rows.filter(F.col("rn") >= model.train_rows))
    rmse = held_out.agg(F.sqrt(F.avg((F.col("y") - F.col("additive")) ** 2))).first()[0]
    assert rmse < 15


def test_calendar_decides_on_seasons(spark):
    def days(*numbers):
        return spark.createDataFrame([(n,) for n in numbers], "d int").select(
            F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("ds")
        )

    def names(df):
        return [s[0] for s in additive.fit_calendar(df).seasons]

    assert names(days(*range(0, 800, 2))) == ["yearly", "weekly"]
    assert names(days(*range(0, 800, 7))) == ["yearly"]
    assert names(days(*range(0, 100))) == ["weekly"]
    assert names(days(*range(0, 13))) == []
    calendar = additive.fit_calendar(days(*range(101)))
    assert calendar.changepoints == pytest.approx(
        [calendar.first_day + 0.8 * j / 25 * 100 for j in range(1, 26)]
    )
    assert len(additive.fit_calendar(days(*range(10))).changepoints) == 7
    assert additive.fit_calendar(days(3, 3)).changepoints == ()
    with pytest.raises(ValueError):
        additive.fit_calendar(days(1))


def test_trend_goes_on_after_the_training_days(spark):
    calendar = additive.Calendar(0, 100, (50.0,), ())
    day = spark.sql("SELECT date_from_unix_date(200) AS ds")
    row = day.select(F.expr(additive.trend(calendar)).alias("t"), F.expr(additive.hinge(50.0, calendar)).alias("h")).first()
    assert tuple(row) == (2.0, 1.5)


def test_hybrid_beats_the_training_mean(model, ranked):
    row = evaluate(model, ranked).first()
    mean = model.train.agg(F.avg("y")).first()[0]
    baseline = (
        ranked.rows.filter(F.col("rn") >= model.train_rows)
        .agg(F.sqrt(F.avg((F.col("y") - mean) ** 2))).first()[0]
    )
    assert row.rmse < 0.8 * baseline
    assert row.mse == pytest.approx(row.rmse**2)


def test_hold_out_predictions_average_both_parts(model, ranked):
    rows = hybrid.predict_hold_out(model, ranked).collect()
    assert len(rows) == ranked.count - model.train_rows
    for r in rows:
        assert r.predicted == pytest.approx((r.additive + r.sequence) / 2)


def test_window_vector_equals_the_wide_scaled_columns(spark):
    """Slot by slot against one-hot columns scaled one by one."""
    codes, length = ["AA", "BB", "CC"], 5
    steps = [
        (float(i % 7), i % 3 + 1, 0, None if i % 4 == 0 else i % 3) for i in range(40)
    ]  # home AA in every row
    train = spark.createDataFrame(
        [(i, *s) for i, s in enumerate(steps)], "rn long, y double, duration int, home_idx int, dest_idx int"
    )
    scaler = MinMax.fit(train, codes)
    windows = with_history(train, scaled_step(scaler), 40, length, 16).select(
        "rn", window_vector(codes, scaler, length).alias("v")
    )
    rows = windows.collect()
    assert len(rows) == 35

    def scaled(feature, value):
        low, high = scaler.bounds[feature]
        return (value - low) / ((high - low) or 1.0)

    for r in rows:
        past = steps[r.rn - length : r.rn]
        want = [scaled("y", s[0]) for s in past] + [scaled("duration", s[1]) for s in past]
        for side, column in (("home", 2), ("dest", 3)):
            for s in past:
                want += [scaled(f"{side}_{c}", float(s[column] == k)) for k, c in enumerate(codes)]
        assert list(r.v.toArray()) == pytest.approx(want)


def test_forecast_parts_add_up(model, requests):
    rows = forecast(model, requests).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.total == pytest.approx((r.additive + r.sequence) / 2)
        assert set(r.breakdown) == {"Air Ticket", "Accommodation", "Daily Allowance", "Others"}
        assert sum(r.breakdown.values()) == pytest.approx(r.total)


def test_forecast_has_no_exchange(model, requests):
    plan = forecast(model, requests)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_fallback_reports_zero_and_leaves_the_total_alone(model, requests, ranked):
    alone = replace(model, sequence=None)
    for r in forecast(alone, requests).collect():
        assert (r.sequence, r.total) == (0.0, r.additive)
    rows = hybrid.predict_hold_out(alone, ranked).collect()
    assert all(r.predicted == r.additive for r in rows)


@pytest.mark.parametrize("rows, fits", [(59, False), (60, False), (61, True)])
def test_sequence_part_needs_a_window(spark, rows, fits):
    ranked = rank_trips(planted_trips(spark, rows), CODES)
    model = fit_hybrid(ranked.rows, rows, CODES)
    assert (model.sequence is not None) == fits
    assert len(model.tail) == min(rows, 60)


BAD = [("AA", "BB", None, 3, 2021), ("AA", "BB", 2, 13, 2021), ("AA", "BB", 2, None, 2021),
       ("AA", "BB", 2, 3, 0)]


def test_a_bad_request_does_not_disturb_the_others(spark, model, requests):
    both = requests.unionByName(spark.createDataFrame(BAD, REQUEST))
    rows = forecast(model, both).collect()
    assert len(rows) == 7
    bad = [r for r in rows if r.total is None]
    assert len(bad) == 4 and all(r.breakdown is None and r.additive is None for r in bad)
    assert sorted(r.total for r in rows if r.total is not None) == sorted(
        r.total for r in forecast(model, requests).collect()
    )


def test_a_stream_goes_on_after_a_bad_request(spark, model, requests):
    base = scratch_path(spark, "stream")
    requests.unionByName(spark.createDataFrame(BAD, REQUEST)).write.parquet(f"{base}/in")

    def run():
        stream = spark.readStream.schema(REQUEST).parquet(f"{base}/in")
        score_stream(model, stream, f"{base}/out", f"{base}/p1", available_now=True).awaitTermination()
        reject_stream(stream, f"{base}/bad", f"{base}/p2", available_now=True).awaitTermination()
        return spark.read.parquet(f"{base}/out").count(), spark.read.parquet(f"{base}/bad").count()

    assert run() == (3, 4)
    requests.limit(1).write.mode("append").parquet(f"{base}/in")
    assert run() == (4, 4)


def test_the_sequence_fit_converges_or_says_so(spark, ranked):
    rows = train_size(ranked.count)
    train = ranked.rows.filter(F.col("rn") < rows)
    scaler = MinMax.fit(train, CODES)
    fitted = fit_sequence(train, rows, CODES, scaler).pipeline.stages[-1]
    assert fitted.summary.totalIterations < fitted.getMaxIter()
    with pytest.raises(RuntimeError, match="did not converge"):
        fit_sequence(train, rows, CODES, scaler, default_regressor(max_iter=2))


def test_no_changepoints_and_no_countries(ranked, requests):
    rows = train_size(ranked.count)
    train = ranked.rows.filter(F.col("rn") < rows)
    plain = additive.Settings(changepoints=0)
    assert additive.fit_calendar(train, plain).changepoints == ()
    model = fit_hybrid(train, rows, [], settings=plain)
    assert forecast(model, requests).filter("total IS NOT NULL").count() == 3


def test_too_many_design_columns_are_refused(ranked):
    with pytest.raises(ValueError, match="design columns"):
        additive.fit_additive(ranked.rows, [f"C{k}" for k in range(2_100)])


def test_a_damaged_bundle_is_an_error(spark, model):
    path = scratch_path(spark, "bundle")
    bundle.save(model, path)
    run = spark.read.parquet(f"{path}/manifest").first().run
    os.rename(f"{path}/runs/{run}/scaler", f"{path}/runs/{run}/lost")
    with pytest.raises(Exception):
        bundle.load_or_train(spark, path, lambda: model)


def test_another_regressor_can_be_plugged_in(ranked, requests):
    rows = train_size(ranked.count)
    model = fit_hybrid(
        ranked.rows.filter(F.col("rn") < rows), rows, CODES, regressor=GBTRegressor(maxIter=2, maxDepth=2, seed=1)
    )
    assert forecast(model, requests).filter("sequence IS NOT NULL").count() == 3


def test_trips_without_a_total_train_nothing(spark):
    trips = planted_trips(spark, 30)
    holed = trips.withColumn("y", F.when(F.col("report_key") % 3 > 0, F.col("y")))
    ranked = rank_trips(holed, CODES)
    assert ranked.count == 20
    assert [r.rn for r in ranked.rows.select("rn").orderBy("rn").collect()] == list(range(20))


def test_saved_bundle_forecasts_the_same(spark, model, requests):
    path = scratch_path(spark, "bundle")
    bundle.save(model, path)
    loaded = bundle.load(spark, path)
    want = forecast(model, requests).collect()
    assert forecast(loaded, requests).collect() == want
    assert loaded.train.count() == model.train_rows
    assert (loaded.tail, loaded.labels, loaded.shares) == (model.tail, model.labels, model.shares)


def test_bundle_trains_only_when_absent_or_asked(spark, model):
    path, calls = scratch_path(spark, "bundle"), []

    def train():
        calls.append(1)
        return replace(model, sequence=None)

    first = bundle.load_or_train(spark, path, train)
    second = bundle.load_or_train(spark, path, train)
    assert len(calls) == 1 and first.sequence is None and second.sequence is None
    bundle.save(model, path)
    assert bundle.load_or_train(spark, path, train).sequence is not None
    assert bundle.load_or_train(spark, path, train, retrain=True).sequence is None
    assert len(calls) == 2


def test_stream_equals_batch_and_does_not_repeat(spark, model, requests):
    base = scratch_path(spark, "stream")
    requests.write.parquet(f"{base}/in")

    def run():
        stream = spark.readStream.schema(REQUEST).parquet(f"{base}/in")
        score_stream(model, stream, f"{base}/out", f"{base}/progress", available_now=True).awaitTermination()
        return spark.read.parquet(f"{base}/out").orderBy("num_days").collect()

    want = forecast(model, requests).orderBy("num_days").collect()
    assert run() == want
    assert run() == want
    requests.limit(1).write.mode("append").parquet(f"{base}/in")
    assert len(run()) == 4


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_released_scratch_is_gone(spark):
    scratch = Scratch(spark, "job")
    kept = scratch.stage(spark.range(5), "numbers")
    assert kept.count() == 5 and os.path.isdir(scratch.root)
    scratch.release()
    assert not os.path.exists(scratch.root)
