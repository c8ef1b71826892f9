"""Expense lines to one row per trip."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripledger.functions.trip import (
    EXPENSE_CATEGORIES,
    expense_category,
    parse_day,
    trip_days,
)

TRIP_META = ("start_date_raw", "end_date_raw", "home_country", "dest_country")
CATEGORY_COLUMNS = {
    "HOTEL": "y_hotel",
    "AIR TICKET": "y_air_ticket",
    "DAILY ALLOWANCE": "spent_allowance",
    "Others": "y_others",
}


def keyed_lines(lines: DataFrame) -> DataFrame:
    """Lines without a trip key belong to no trip."""
    return lines.filter(F.col("report_key").isNotNull())


def _category_total(category: str) -> Column:
    """Sum of one category in the amount's own type; null where there is none.

    An amount that is not a number counts as missing, whatever its source.
    """
    hit = (expense_category(F.col("expense_type")) == category) & ~F.isnan(
        F.col("amount_eur").cast("double")
    )
    return F.sum(F.when(hit, F.col("amount_eur")))


def _as_amount(total: Column) -> Column:
    return F.coalesce(total.cast("double"), F.lit(0.0))


def category_sum(category: str) -> Column:
    """Sum of one category, added up in the amount's own type; 0 where there is none."""
    return _as_amount(_category_total(category))


def _is_complete() -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in TRIP_META])


def first_known_states() -> list[Column]:
    """Aggregates that hold the first non-null value of every trip fact.

    Most lines have all facts, so the first such line is kept whole with its
    row order once. A column's own first value is kept beside it only from
    lines that lack another fact; it stays null on clean data, which keeps the
    shuffled state small.
    """
    complete = _is_complete()
    whole = F.min(F.when(complete, F.struct("row_ord", *TRIP_META))).alias("first_whole")
    partial = [
        F.min(F.when(~complete & F.col(c).isNotNull(), F.struct("row_ord", c))).alias(f"first_{c}")
        for c in TRIP_META
    ]
    return [whole, *partial]


def first_known(name: str) -> Column:
    """The earlier of both candidates of :func:`first_known_states`."""
    whole, own = F.col("first_whole"), F.col(f"first_{name}")
    earlier = whole.isNull() | (own["row_ord"] < whole["row_ord"])
    return F.when(earlier, own[name]).otherwise(whole[name]).alias(name)


def pivot_expenses(lines: DataFrame) -> DataFrame:
    """Trip by category sums. The category list is fixed, so no discovery job runs."""
    return (
        keyed_lines(lines)
        .groupBy("report_key")
        .agg(*[category_sum(c).alias(CATEGORY_COLUMNS[c]) for c in EXPENSE_CATEGORIES])
    )


def trip_meta(lines: DataFrame) -> DataFrame:
    return (
        keyed_lines(lines)
        .groupBy("report_key")
        .agg(*first_known_states())
        .select("report_key", *[first_known(c) for c in TRIP_META])
    )


def roll_up(lines: DataFrame) -> DataFrame:
    """Sums and trip facts in one aggregation: one shuffle on the trip key.

    Every aggregate merges partial states, so a key that holds a large part of
    the lines is reduced before it is shuffled.
    """
    return (
        keyed_lines(lines)
        .groupBy("report_key")
        .agg(
            *first_known_states(),
            *[category_sum(c).alias(CATEGORY_COLUMNS[c]) for c in EXPENSE_CATEGORIES],
        )
        .select("report_key", *[first_known(c) for c in TRIP_META], *CATEGORY_COLUMNS.values())
    )


def line_states(lines: DataFrame) -> DataFrame:
    """One state for each trip of these lines; states of one trip can be merged.

    A state holds the first known facts with their row order and the sums of the
    categories, null where there is no amount. Decimal sums get all 38 digits,
    so merging keeps both type and value.
    """
    kind = lines.schema["amount_eur"].dataType
    wide = T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DoubleType()
    sums = [_category_total(c).cast(wide).alias(CATEGORY_COLUMNS[c]) for c in EXPENSE_CATEGORIES]
    return keyed_lines(lines).groupBy("report_key").agg(*first_known_states(), *sums)


def merge_states(states: DataFrame) -> DataFrame:
    """One state for each trip from any number of them, in any order."""
    kept = [c for c in states.columns if c.startswith("first_")]
    sums = [
        F.sum(c).cast(states.schema[c].dataType).alias(c) for c in CATEGORY_COLUMNS.values()
    ]
    return states.groupBy("report_key").agg(*[F.min(c).alias(c) for c in kept], *sums)


def rolled_states(states: DataFrame) -> DataFrame:
    """What :func:`roll_up` gives, from one state for each trip."""
    return states.select(
        "report_key",
        *[first_known(c) for c in TRIP_META],
        *[_as_amount(F.col(c)).alias(c) for c in CATEGORY_COLUMNS.values()],
    )


def with_dates(rolled: DataFrame, quarantine: bool = False) -> DataFrame:
    """Parse the first known dates and derive the duration."""
    return (
        rolled.withColumn("ds", parse_day(F.col("start_date_raw"), quarantine))
        .withColumn("end_date", parse_day(F.col("end_date_raw"), quarantine))
        .withColumn("duration", trip_days(F.col("ds"), F.col("end_date")))
        .drop("start_date_raw", "end_date_raw", "end_date")
    )
