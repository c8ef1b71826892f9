import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import planted_trips
from tripledger.models import hybrid, lagged
from tripledger.models.lagged import fit_lagged
from tripledger.models.sequence import default_regressor, fit_sequence, scaled_step
from tripledger.operators.ranks import rank_rows
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import with_history
from tripledger.plans.trips import rank_trips

CODES = ["AA", "BB", "CC", "DD"]


@pytest.fixture(scope="module")
def trips(spark):
    return rank_trips(planted_trips(spark, 400), CODES)


def windows_of(rows, codes, length, scaler):
    """Windows, flattened, and their targets, by plain loops."""
    def scaled(feature, value):
        low, high = scaler.bounds[feature]
        return (value - low) / ((high - low) or 1.0)

    steps = []
    for r in rows:
        step = [1.0, scaled("y", r.y), scaled("duration", r.duration)]
        for position in (r.home_idx, r.dest_idx):
            step += [float(position == k) for k in range(len(codes))]
        steps.append(step)
    steps = np.array(steps)
    x = np.array([steps[i - length : i] for i in range(length, len(rows))])
    return x, steps[length:, 1]


@pytest.mark.parametrize("rows, length, block", [(400, 6, 7), (400, 5, 100), (13, 12, 64), (25, 12, 12), (9, 1, 2)])
def test_gram_products_equal_those_of_written_windows(spark, trips, rows, length, block):
    train = trips.before(rows)
    scaler = MinMax.fit(train, CODES)
    held = train.orderBy("rn").collect()
    x, z = windows_of(held, CODES, length, scaler)
    steps = train.select("rn", scaler.scale("y", F.col("y")).alias("y"),
                         scaler.scale("duration", F.col("duration")).cast("double").alias("duration"),
                         "home_idx", "dest_idx")
    products = lagged.lag_products(steps, rows, len(CODES), length, block)
    layout = lagged.Layout(len(CODES))
    edge = [tuple(r)[1:] for r in steps.orderBy("rn").collect()]
    gram = lagged.WindowGram.of(
        products, lagged._edge(edge[:length], layout), lagged._edge(edge[-length:], layout), rows
    )
    flat = x.reshape(len(x), -1)
    p = np.random.default_rng(1).normal(size=x.shape[1:])
    assert gram.times(p).ravel() == pytest.approx(flat.T @ (flat @ p.ravel()), rel=1e-9, abs=1e-9)
    assert gram.diagonal().ravel() == pytest.approx((flat**2).sum(axis=0), abs=1e-9)
    assert gram.target.ravel() == pytest.approx(flat.T @ z, abs=1e-9)
    assert gram.sums().ravel() == pytest.approx(flat.sum(axis=0), abs=1e-9)


@pytest.mark.parametrize("length", [1, 8, 60])
def test_weights_equal_the_regression_on_window_vectors(spark, trips, length):
    rows = 320
    train = trips.before(rows)
    scaler = MinMax.fit(train, CODES)
    ours = fit_lagged(train, rows, CODES, scaler, length)
    # The other fit stops by its tolerance, so it is made to go far.
    other = fit_sequence(train, rows, CODES, scaler, default_regressor(tol=1e-14), length)
    linear = other.pipeline.stages[-1]
    flat = linear.coefficients.toArray()
    k = len(CODES)
    want = np.zeros(ours.weights.shape)
    want[:, 1], want[:, 2] = flat[:length], flat[length : 2 * length]
    want[:, 3 : 3 + k] = flat[2 * length : (2 + k) * length].reshape(length, k)
    want[:, 3 + k :] = flat[(2 + k) * length :].reshape(length, k)
    assert ours.weights == pytest.approx(want, abs=2e-6)
    assert ours.intercept == pytest.approx(linear.intercept, abs=2e-6)


def test_without_a_penalty_and_countries_it_is_least_squares(spark, trips):
    train = trips.before(200)
    scaler = MinMax.fit(train, [])
    x, z = windows_of(train.orderBy("rn").collect(), [], 3, scaler)
    design = np.hstack([np.ones((len(z), 1)), x[:, :, 1:].reshape(len(z), -1)])
    want = np.linalg.lstsq(design, z, rcond=None)[0]
    ours = fit_lagged(train, 200, [], scaler, 3, penalty=0.0)
    assert ours.intercept == pytest.approx(want[0], abs=1e-8)
    assert ours.weights[:, 1:].ravel() == pytest.approx(want[1:], abs=1e-8)


def test_a_constant_total_and_too_few_rows(spark):
    frame = spark.createDataFrame([(k, 5.0, 2, 0, None) for k in range(30)],
                                  "id long, y double, duration int, home_idx int, dest_idx int")
    ranked = rank_rows(frame, "id")
    scaler = MinMax.fit(ranked.rows, CODES)
    flat = fit_lagged(ranked.rows, 30, CODES, scaler, 4)
    assert not flat.weights.any() and flat.intercept == 0.0  # the scaled total
    assert fit_lagged(ranked.rows, 30, CODES, scaler, 30) is None


def test_the_fit_builds_no_windows_and_shuffles_narrow_rows(spark, trips):
    steps = trips.rows.select("rn", "y", "duration", "home_idx", "dest_idx")
    plan = lagged._blocks(steps, 400, 60, 128)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in text and "history" not in text and "Window" not in text
    assert plan.columns == ["rn", "y", "duration", "home_idx", "dest_idx", "block"]


def test_window_scores_equal_request_scores_and_plain_arithmetic(spark, trips):
    rows = 320
    train = trips.before(rows)
    scaler = MinMax.fit(train, CODES)
    model = fit_lagged(train, rows, CODES, scaler, 60)
    windows = with_history(trips.rows, scaled_step(scaler), trips.count, 60, 128).filter("rn >= 320")
    got = {r.rn: r.sequence for r in model.transform(windows).collect()}
    x, _ = windows_of(trips.rows.orderBy("rn").collect(), CODES, 60, scaler)
    low, high = scaler.bounds["y"]
    want = ((x * model.weights).sum(axis=(1, 2)) + model.intercept) * (high - low) + low
    assert [got[k] for k in range(320, 400)] == pytest.approx(want[260:], rel=1e-9)
    # A request's window by its history array, and as a constant plus its own step.
    tail = hybrid.tail_steps(train, scaler)
    requests = spark.createDataFrame(
        [("AA", "BB", 5, 3, 2021), ("ZZ", None, 0, 12, None), ("DD", "CC", 40, 7, 2031)],
        "home_country string, dest_country string, num_days int, month int, year int",
    )
    future = hybrid.future_rows(requests, CODES)
    native = model.forecast(future, tail)
    plan = native._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
    by_array = model.transform(hybrid.with_request_window(future, tail, scaler))
    key = ["num_days"]
    assert [r.sequence for r in native.orderBy(key).collect()] == pytest.approx(
        [r.sequence for r in by_array.orderBy(key).collect()], rel=1e-9
    )


def test_saved_weights_are_the_same(spark, trips):
    scaler = MinMax.fit(trips.rows, CODES)
    model = fit_lagged(trips.rows, 400, CODES, scaler, 7)
    loaded = lagged.LaggedModel.from_table(model.table(spark), CODES, scaler)
    assert (loaded.weights == model.weights).all() and loaded.intercept == model.intercept
