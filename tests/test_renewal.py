"""A stream takes a new model from the next batch on; old bundles can be retired."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fixtures import planted_trips
from tripledger.models import bundle, hybrid
from tripledger.operators.ranks import train_size
from tripledger.plans.trips import rank_trips
from tripledger.session import path_exists, scratch_path
from tripledger.streaming.scoring import score_stream_with_newest

CODES = ["AA", "BB", "CC", "DD"]
REQUEST = "home_country string, dest_country string, num_days int, month int, year int"


@pytest.fixture(scope="module")
def models(spark):
    made = []
    for seed in (1, 2):
        ranked = rank_trips(planted_trips(spark, 120, seed=seed, noise=50.0), CODES)
        rows = train_size(ranked.count)
        made.append(hybrid.fit_hybrid(ranked.before(rows), rows, CODES, with_sequence=False))
    return made


def asked(spark, *days):
    return spark.createDataFrame([("AA", "BB", d, 3, 2021) for d in days], REQUEST)


def totals(model, frame):
    return {r.num_days: r.total for r in hybrid.forecast(model, frame).collect()}


def test_a_bundle_saved_midway_is_used_from_the_next_batch(spark, models):
    base = scratch_path(spark, "renewal")
    with pytest.raises(FileNotFoundError):
        score_stream_with_newest(spark, f"{base}/bundle", asked(spark, 1), f"{base}/out", f"{base}/p")
    bundle.save(models[0], f"{base}/bundle")
    first = bundle.newest_run(spark, f"{base}/bundle")
    asked(spark, 1, 2).coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(REQUEST).parquet(f"{base}/in")
    running = score_stream_with_newest(spark, f"{base}/bundle", stream, f"{base}/out", f"{base}/p")
    try:
        running.processAllAvailable()
        bundle.save(models[1], f"{base}/bundle")
        second = bundle.newest_run(spark, f"{base}/bundle")
        asked(spark, 3, 4).coalesce(1).write.mode("append").parquet(f"{base}/in")
        running.processAllAvailable()
    finally:
        running.stop()
    rows = spark.read.parquet(f"{base}/out").collect()
    assert {r.num_days: r.model_run for r in rows} == {1: first, 2: first, 3: second, 4: second}
    want = totals(models[0], asked(spark, 1, 2)) | totals(models[1], asked(spark, 3, 4))
    assert {r.num_days: r.total for r in rows} == pytest.approx(want)
    assert want[3] != totals(models[0], asked(spark, 3))[3]


def test_a_restart_repeats_nothing_and_a_replayed_batch_replaces_itself(spark, models):
    base = scratch_path(spark, "restart")
    bundle.save(models[0], f"{base}/bundle")
    first = bundle.newest_run(spark, f"{base}/bundle")
    asked(spark, 1, 2).coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(REQUEST).parquet(f"{base}/in")

    def run(progress="p"):
        score_stream_with_newest(
            spark, f"{base}/bundle", stream, f"{base}/out", f"{base}/{progress}", available_now=True
        ).awaitTermination()
        return sorted((r.num_days, r.model_run) for r in spark.read.parquet(f"{base}/out").collect())

    want = [(1, first), (2, first)]
    assert run() == want
    bundle.save(models[1], f"{base}/bundle")
    assert run() == want
    # As if the driver was lost after the rows were written, before the batch was noted.
    delete = bundle.delete_path
    delete(spark, f"{base}/p/progress/commits")
    assert run() == want
    # ... and as if it was lost while they were written: the batch is made anew.
    delete(spark, f"{base}/p/progress/commits")
    folder = spark.read.parquet(f"{base}/out").select("stream").first()["stream"]
    delete(spark, f"{base}/out/stream={folder}/batch=0/_SUCCESS")
    second = bundle.newest_run(spark, f"{base}/bundle")
    assert run() == [(1, second), (2, second)]
    # A new checkpoint is a new stream: its batch 0 is not taken for the old one.
    assert len(run("other")) == 4


def test_requests_with_names_of_the_output_are_an_error(spark, models):
    base = scratch_path(spark, "clash")
    bundle.save(models[0], base)
    with pytest.raises(ValueError, match="batch"):
        score_stream_with_newest(spark, base, asked(spark, 1).withColumn("Batch", F.lit(1)), base, base)


def test_old_bundles_can_be_retired(spark, models):
    base = scratch_path(spark, "retire")
    runs = []
    for model in (*models, models[0]):
        bundle.save(model, base)
        runs.append(bundle.newest_run(spark, base))
    assert bundle.retire(spark, base, keep=2) == runs[:1]
    assert [path_exists(spark, f"{base}/runs/{r}") for r in runs] == [False, True, True]
    assert totals(bundle.load(spark, base, runs[1]), asked(spark, 9)) == totals(models[1], asked(spark, 9))
    assert totals(bundle.load(spark, base), asked(spark, 9)) == totals(models[0], asked(spark, 9))
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, base, "unknown")
    with pytest.raises(ValueError):
        bundle.retire(spark, base, keep=0)
