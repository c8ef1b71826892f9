"""Daily-allowance rates on trips and the trip total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.schemas import TRIP_COLUMNS


#: Rates that may be broadcast, a few MB; a longer table is joined by measured sizes.
BROADCAST_RATES = 100_000


def check_rates(rates: DataFrame) -> int:
    """Row count of the rate table; a country with two rates is an error.

    A second rate for a country would duplicate its trips.
    """
    found = rates.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(F.struct("country")).alias("countries"),
    ).first()
    if found["rows"] != found["countries"]:
        raise ValueError(
            f"rate table has {found['rows']} rows for {found['countries']} countries"
        )
    return found["rows"]


def join_rates(trips: DataFrame, rates: DataFrame) -> DataFrame:
    """Rate of the home country, null where there is none. Null matches null.

    The check counts the rates, so their size is known: a table within
    ``BROADCAST_RATES`` is broadcast and the trips, whose home countries are few
    and hot, are not shuffled. Beyond it, or in a session that switches
    broadcasts off, measured sizes decide at run time.
    """
    threshold = trips.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    dim = rates.select(F.col("country").alias("rate_country"), "daily_allowance")
    if check_rates(rates) <= BROADCAST_RATES and not threshold.startswith("-"):
        dim = F.broadcast(dim)
    return trips.join(
        dim,
        F.col("home_country").eqNullSafe(F.col("rate_country")),
        "left",
    ).drop("rate_country")


def rate_median(rated: DataFrame) -> DataFrame:
    """Exact median over trips, so a country weighs by its trips.

    Trips are counted per rate before the median: however many tasks there
    are, the last one sees each distinct rate once.
    """
    return (
        rated.groupBy("daily_allowance")
        .agg(F.count(F.lit(1)).alias("trips"))
        .agg(F.percentile("daily_allowance", 0.5, F.col("trips")).alias("median_allowance"))
    )


def fill_rates(rated: DataFrame) -> DataFrame:
    """Missing rates get the median, an uncorrelated scalar subquery.

    The subquery reads only what the median needs of the trips.
    """
    return rated.withColumn(
        "daily_allowance", F.coalesce("daily_allowance", rate_median(rated).scalar())
    )


def with_totals(filled: DataFrame) -> DataFrame:
    """The official allowance replaces what was spent under that heading."""
    return (
        filled.withColumn("y_daily_allowance", F.col("daily_allowance") * F.col("duration"))
        .withColumn(
            "y",
            F.col("y_hotel")
            + F.col("y_air_ticket")
            + F.col("y_daily_allowance")
            + F.col("y_others"),
        )
        .select(*TRIP_COLUMNS)
    )
