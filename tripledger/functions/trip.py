"""Scalar rules of a trip: category, dates, duration, country flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three named expense types; everything else is "Others".
MAIN_EXPENSES = ("HOTEL", "AIR TICKET", "DAILY ALLOWANCE")
OTHER_EXPENSES = "Others"
EXPENSE_CATEGORIES = (*MAIN_EXPENSES, OTHER_EXPENSES)

DEFAULT_YEAR = 2025


def expense_category(expense_type: Column) -> Column:
    """Exact, case-sensitive match; null and unknown types are "Others"."""
    return F.when(expense_type.isin(*MAIN_EXPENSES), expense_type).otherwise(OTHER_EXPENSES)


def parse_day(raw: Column, quarantine: bool = False) -> Column:
    """``yyyyMMdd`` text to a date. A wrong date is an error, or null on request."""
    return F.try_to_date(raw, "yyyyMMdd") if quarantine else F.to_date(raw, "yyyyMMdd")


def trip_days(start: Column, end: Column) -> Column:
    """Days from start to end, at least 1. Unlike ``greatest`` it keeps nulls."""
    days = F.datediff(end, start)
    return F.when(days < 1, 1).otherwise(days)


def request_day(year: Column, month: Column) -> Column:
    """First day of the requested month, null for a month or year that does not exist."""
    chosen = F.coalesce(year, F.lit(DEFAULT_YEAR))
    exists = month.between(1, 12) & chosen.between(1, 9999)
    return F.when(exists, F.make_date(chosen, month, F.lit(1)))


def one_hot_flag(country: Column, code: str) -> Column:
    """1 where the country is ``code``, else 0, also for null."""
    return F.coalesce((country == code).cast("int"), F.lit(0))


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")
