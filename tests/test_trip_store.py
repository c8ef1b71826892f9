"""Trips kept up to date by batches, against one roll-up of all lines."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fixtures import LINE_SCHEMA
from tripledger.operators.rollup import roll_up
from tripledger.session import path_exists, scratch_path
from tripledger.sources.trip_store import TripStore


def random_lines(spark, n=300, kind="decimal(18,2)"):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        def maybe(value):
            return None if rng.random() < 0.4 else value

        rows.append(
            (
                None if rng.random() < 0.05 else rng.choice([1, 1, 1, rng.randrange(60)]),
                rng.randrange(10**6) * n + i,
                maybe(f"202301{rng.randint(1, 28):02d}"),
                maybe(f"202302{rng.randint(1, 28):02d}"),
                maybe(rng.choice("ABC")),
                maybe(rng.choice("ABC")),
                rng.choice(["HOTEL", "AIR TICKET", "DAILY ALLOWANCE", "TAXI", None]),
                maybe(rng.randrange(10**6) / 100),
            )
        )
    return spark.createDataFrame(rows, LINE_SCHEMA).withColumn("amount_eur", F.col("amount_eur").cast(kind))


def same(left, right):
    return sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, right.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_order_of_batches_gives_the_roll_up(spark, seed):
    lines = random_lines(spark).withColumn("deal", F.floor(F.rand(seed) * 6)).cache()
    store = TripStore(spark, scratch_path(spark, "store"), fan=2)
    numbers = list(range(6))
    random.Random(seed).shuffle(numbers)
    for k in numbers:
        assert store.append(lines.filter(F.col("deal") == k).drop("deal"), str(k))
    assert same(store.rolled(), roll_up(lines))


def test_a_repeated_batch_changes_nothing_and_an_empty_one_is_remembered(spark):
    lines = random_lines(spark, 60)
    store = TripStore(spark, scratch_path(spark, "store"))
    assert store.append(lines, "a") and not store.append(lines, "a")
    assert store.append(lines.limit(0), "b") and not store.append(lines, "b")
    assert same(store.rolled(), roll_up(lines))
    # Another writer, for example after a restart, knows the batches as well.
    assert not TripStore(spark, store.path).append(lines, "a")


def test_a_late_line_with_a_smaller_order_wins(spark):
    def line(order, home):
        return spark.createDataFrame(
            [(7, order, "20230101", "20230103", home, "PL", "HOTEL", 10.0)], LINE_SCHEMA
        )

    store = TripStore(spark, scratch_path(spark, "store"))
    store.append(line(5, "SE"), "first")
    store.append(line(2, "IT"), "late")
    store.append(line(9, "FR"), "last")
    row = store.rolled().first()
    assert (row.home_country, row.y_hotel) == ("IT", 30.0)


def test_levels_are_merged_and_appending_reads_no_history(spark):
    lines = random_lines(spark, 80)
    store = TripStore(spark, scratch_path(spark, "store"), fan=2)
    for k in range(8):
        store.append(lines.filter(F.col("row_ord") % 8 == k), str(k))
        live = store._live(store._manifest())
        assert len(live) == bin(k + 1).count("1")
    before = store.rolled().collect()
    assert store.vacuum() == 14
    assert [path_exists(spark, f"{store.path}/entries/{r['entry']}") for r in live] == [True]
    assert sorted(map(repr, store.rolled().collect())) == sorted(map(repr, before))


def test_a_job_lost_before_its_manifest_row_leaves_nothing(spark, monkeypatch):
    lines = random_lines(spark, 40)
    store = TripStore(spark, scratch_path(spark, "store"))
    store.append(lines.filter(F.col("row_ord") % 2 == 0), "even")
    odd = lines.filter(F.col("row_ord") % 2 == 1)
    with monkeypatch.context() as patch:
        patch.setattr(spark, "createDataFrame", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.append(odd, "odd")
    assert store.append(odd, "odd")
    assert same(store.rolled(), roll_up(lines))


def test_amounts_keep_their_type_and_an_empty_store_is_an_error(spark):
    store = TripStore(spark, scratch_path(spark, "store"))
    with pytest.raises(FileNotFoundError):
        store.rolled()
    store.append(random_lines(spark, 20), "a")
    with pytest.raises(ValueError, match="states of"):
        store.append(random_lines(spark, 20, "decimal(18,3)"), "b")
    with pytest.raises(ValueError):
        TripStore(spark, store.path, fan=1)


def test_entries_are_written_small(spark):
    store = TripStore(spark, scratch_path(spark, "store"))
    assert store.append(random_lines(spark), "one")
    files = [r.name for r in spark.read.parquet(f"{store.path}/entries/*").select(
        F.input_file_name().alias("name")
    ).distinct().collect()]
    assert files and all(".zstd." in name for name in files)
