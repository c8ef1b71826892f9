"""Plans that must not shuffle: reading ranked rows and joining few rates."""

from pyspark.sql import functions as F

from tripledger.operators import allowance
from tripledger.operators.ranks import rank_rows
from tripledger.sources.countries import builtin_rates


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranked_rows_are_read_without_an_exchange(spark):
    ranked = rank_rows(spark.range(2_000_000).withColumn("x", F.hash("id")), "x", "id")
    for read in (ranked.rows, ranked.since(1_500_000), ranked.before(700_000)):
        assert "Exchange" not in plan_of(read) and "Join" not in plan_of(read)
    assert ranked.rows.agg(F.sum("rn"), F.count_distinct("rn")).first() == (1999999 * 1000000, 2000000)
    assert ranked.before(700_000).agg(F.max("rn"), F.count("*")).first() == (699_999, 700_000)
    assert ranked.since(1_500_000).agg(F.min("rn"), F.count("*")).first() == (1_500_000, 500_000)
    pushed = plan_of(ranked.before(10)).split("PushedFilters")[1]
    assert "LessThanOrEqual(part" in pushed


def test_positions_where_partitions_are_empty(spark):
    frame = spark.createDataFrame([(k % 2, k) for k in range(40)], "a int, b int")
    ranked = rank_rows(frame, "a", "b")
    assert [r.rn for r in ranked.rows.orderBy("a", "b").collect()] == list(range(40))
    assert rank_rows(frame.limit(0), "a", "b").rows.count() == 0


def test_few_rates_do_not_shuffle_the_trips(spark):
    trips = spark.range(2_000_000).select(
        "id", F.element_at(F.array(F.lit("DE"), F.lit("SE"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("home_country")
    )
    joined = allowance.join_rates(trips, builtin_rates(spark))
    assert "Exchange hashpartitioning" not in plan_of(joined) and "Broadcast" in plan_of(joined)
    assert joined.filter("daily_allowance IS NOT NULL").count() == 1_333_334
