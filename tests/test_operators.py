import math
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fixtures import planted_trips
from tripledger.functions.trip import month_name
from tripledger.operators import encode, metrics, ranks, windows
from tripledger.operators.scaling import MinMax
from tripledger.plans.trips import rank_trips
from tripledger.session import CLEAN_UP, Scratch

LABELS = ["AA", "BB", "CC"]


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "report_key long, home_country string, dest_country string")


def test_category_index_and_one_hot_agree(spark):
    df = pairs(spark, (1, "AA", "CC"), (2, "ZZ", "BB"), (3, None, "AA"))
    index = {r.report_key: r for r in encode.with_category_index(df, LABELS).collect()}
    assert [(index[k].home_idx, index[k].dest_idx) for k in (1, 2, 3)] == [(0, 2), (None, 1), (None, 0)]
    wide = encode.one_hot_wide(df, LABELS)
    sparse = encode.one_hot(LABELS, df).transform(df)
    for w, s in zip(wide.orderBy("report_key").collect(), sparse.orderBy("report_key").collect()):
        assert [w[f"home_{c}"] for c in LABELS] == list(s.home_vec.toArray())
        assert [w[f"dest_{c}"] for c in LABELS] == list(s.dest_vec.toArray())


def test_feature_names():
    columns = ["report_key", "y", "duration", "home_AA", "dest_AA", "ds"]
    assert encode.feature_names(columns) == ["duration", "home_AA", "dest_AA"]
    assert encode.feature_names(columns, with_target=True)[0] == "y"


def test_domain_is_sorted_and_distinct(spark):
    countries = spark.createDataFrame([("B", "b"), ("A", "a"), ("B", "b")], "code string, name string")
    assert encode.domain_of(countries) == ["A", "B"]
    many = spark.range(2_001).select(F.concat(F.lit("C"), "id").alias("code"))
    assert len(encode.domain_of(many)) == 2_001


def test_country_names(spark):
    dim = spark.createDataFrame([("AA", "Alpha")], "code string, name string")
    df = encode.with_country_names(pairs(spark, (1, "AA", "AA"), (2, "ZZ", "BB")), "home_country", dim, "home_name")
    assert [r.home_name for r in df.orderBy("report_key").collect()] == ["Alpha", None]


def test_rank_equals_a_global_row_number(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10**12), 3000) + list(range(-2000, 0))
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "report_key long").repartition(7)
    ranked = ranks.rank_rows(df, "report_key")
    assert ranked.count == 5000
    found = {r.report_key: r.rn for r in ranked.rows.collect()}
    assert found == {k: i for i, k in enumerate(sorted(keys))}


def test_rows_since_a_position_skip_earlier_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(6)
    ranked = ranks.rank_rows(df, "k")
    want = {r.k: r.rn for r in ranked.rows.collect()}
    for first in (0, 1, 2500, 4990, 5000):
        found = ranked.since(first)
        assert {r.k: r.rn for r in found.collect()} == {k: n for k, n in want.items() if n >= first}
    plan = ranked.since(4990)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(part," in plan


def test_ties_do_not_follow_the_order_of_delivery(spark):
    trips = planted_trips(spark, 300).withColumn("ds", F.lit("2023-01-01").cast("date"))
    found = [
        {r.report_key: r.rn for r in rank_trips(t, ["AA"], ("ds",)).rows.collect()}
        for t in (trips.repartition(5), trips.orderBy(F.desc("report_key")).repartition(3))
    ]
    assert found[0] == found[1] and len(found[0]) == 300


def test_rank_by_several_columns_and_of_nothing(spark):
    df = spark.createDataFrame([(2, "a"), (1, "b"), (1, "a")], "n long, s string")
    found = {(r.n, r.s): r.rn for r in ranks.rank_rows(df, "n", "s").rows.collect()}
    assert found == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 2}
    assert ranks.rank_rows(df.filter("n > 5"), "n").count == 0


@pytest.mark.parametrize("n, train", [(2, 1), (5, 4), (10, 8), (11, 8), (35, 28), (14743, 11794)])
def test_train_size(n, train):
    assert ranks.train_size(n) == train == n - math.ceil(0.2 * n)


@pytest.mark.parametrize("n", [0, 1])
def test_too_few_rows_to_split(n):
    with pytest.raises(ValueError):
        ranks.train_size(n)


def steps(spark, n):
    return spark.range(n).select(
        F.col("id").alias("rn"),
        (F.col("id") * 1.5).alias("y"),
        (F.col("id") % 9).alias("duration"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).cast("int").alias("home_idx"),
        (F.col("id") % 2).cast("int").alias("dest_idx"),
    )


def raw():
    return windows.step(F.col("y"), F.col("duration"), F.col("home_idx"), F.col("dest_idx"))


@pytest.mark.parametrize("n, length, block", [(500, 60, 60), (500, 60, 64), (333, 7, 10), (61, 60, 2048)])
def test_blocks_give_the_windows_of_a_global_frame(spark, n, length, block):
    df = steps(spark, n)
    frame = Window.orderBy("rn").rowsBetween(-length, -1)
    want = {
        r.rn: r.h
        for r in df.select("rn", F.collect_list(raw()).over(frame).alias("h")).collect()
        if len(r.h) == length
    }
    found = windows.with_history(df, raw(), n, length, block).collect()
    assert len(found) == len(want) == n - length
    assert {r.rn: r.history for r in found} == want


def test_no_window_without_enough_rows(spark):
    assert windows.with_history(steps(spark, 60), raw(), 60).count() == 0


def test_block_shorter_than_window_is_rejected(spark):
    with pytest.raises(ValueError):
        windows.with_history(steps(spark, 5), raw(), 5, length=60, block_rows=59)


def scaled_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "y double, duration int, home_idx int, dest_idx int")


def test_min_max_equals_the_wide_columns(spark):
    df = scaled_rows(spark, (5.0, 3, 0, 1), (9.0, 3, 0, None), (7.0, 3, 0, 2))
    scaler = MinMax.fit(df, LABELS)
    assert scaler.bounds["y"] == (5.0, 9.0)
    assert scaler.bounds["home_AA"] == (1.0, 1.0)
    assert scaler.bounds["home_BB"] == (0.0, 0.0)
    assert scaler.bounds["dest_BB"] == scaler.bounds["dest_CC"] == (0.0, 1.0)
    assert scaler.always_on("home", LABELS) == {0}
    assert MinMax.from_table(scaler.table(spark)) == scaler
    slots = df.select(scaler.scaled_slot("home", LABELS).alias("h"), scaler.scaled_slot("dest", LABELS).alias("d"))
    assert [tuple(r) for r in slots.collect()] == [(0.0, 1.0), (0.0, 0.0), (0.0, 1.0)]


def test_constant_feature_and_out_of_range_values(spark):
    df = scaled_rows(spark, (5.0, 3, 0, 0), (9.0, 3, 0, 0))
    scaler = MinMax.fit(df, LABELS)
    row = df.limit(1).select(
        scaler.scale("duration", F.lit(3)).alias("constant"),
        scaler.restore("duration", F.lit(0.0)).alias("back"),
        scaler.scale("y", F.lit(0.0)).alias("below"),
        scaler.restore("y", scaler.scale("y", F.lit(6.25))).alias("same"),
    ).first()
    assert tuple(row) == (0.0, 3.0, -1.25, 6.25)


def test_error_metrics_and_average(spark):
    first = spark.createDataFrame([(1, 10.0, 8.0), (2, 20.0, 30.0)], "k int, y double, additive double")
    second = spark.createDataFrame([(2, 10.0), (1, 16.0)], "k int, sequence double")
    aligned = metrics.align_predictions(first, second, "k")
    assert [r.hybrid for r in aligned.orderBy("k").collect()] == [12.0, 20.0]
    row = metrics.error_metrics(aligned, "y", "hybrid").first()
    assert (row.mse, row.rmse) == (2.0, pytest.approx(math.sqrt(2)))


def test_breakdown_adds_up_and_unpivots(spark):
    shares = {"Air Ticket": 0.5, "Accommodation": 0.25, "Daily Allowance": 0.2, "Others": 0.05}
    df = spark.createDataFrame([(1, 1234.5, 1000.0, 1469.0)], "k int, total double, additive double, sequence double")
    split = df.withColumn("breakdown", metrics.breakdown(F.col("total"), shares))
    long = {r.item: r.cost for r in metrics.breakdown_long(split, ["k"]).collect()}
    assert list(long) == list(shares) and sum(long.values()) == pytest.approx(1234.5, abs=0.02)
    assert long["Others"] == 61.73
    series = {r.series: r.value for r in metrics.forecast_series(df, ["k"]).collect()}
    assert series == {"additive": 1000.0, "sequence": 1469.0, "total": 1234.5}


def test_written_steps_take_their_shuffles_along(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    folders = [Path(folder.getPath()) for folder in folders]

    def shuffles():
        return {f.name for folder in folders for f in folder.rglob("shuffle_*")}

    def step():
        return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()

    before = shuffles()
    assert step().count() == 7 and shuffles() - before
    before = shuffles()
    scratch = Scratch(spark, "steps")
    assert scratch.stage(step(), "counts").count() == 7  # this count has a shuffle of its own
    deadline = time.monotonic() + 20
    while len({n.split("_")[1] for n in shuffles() - before}) > 1 and time.monotonic() < deadline:
        time.sleep(0.1)
    assert len({n.split("_")[1] for n in shuffles() - before}) <= 1
    assert CLEAN_UP not in spark.conf.getAll
    scratch.release()


def test_month_names(spark):
    names = [r[0] for r in spark.range(1, 13).select(month_name(F.col("id").cast("int"))).collect()]
    assert names[0] == "January" and names[11] == "December"
