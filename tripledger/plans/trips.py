"""The trip table and its ranked, encoded form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripledger.operators.allowance import fill_rates, join_rates, with_totals
from tripledger.operators.encode import with_category_index
from tripledger.operators.ranks import Ranked, rank_rows
from tripledger.operators.rollup import roll_up, with_dates
from tripledger.session import stage


def build_trips(
    lines: DataFrame, rates: DataFrame, quarantine: bool = False, staged: bool = True
) -> DataFrame:
    """Expense lines to trips with their official allowance and total.

    One scan of the lines, one shuffle on the trip key, one small join and one
    scalar subquery for the median rate. The roll-up is written once, because
    both the trips and the median need it; without ``staged`` nothing is written
    and the median takes its own pass over the lines.
    """
    return price_trips(roll_up(lines), rates, quarantine, staged)


def price_trips(
    rolled: DataFrame, rates: DataFrame, quarantine: bool = False, staged: bool = True
) -> DataFrame:
    """Rolled-up trips, from lines or from a trip store, with allowance and total."""
    dated = with_dates(rolled, quarantine)
    if staged:
        dated = stage(dated, "rollup")
    return with_totals(fill_rates(join_rates(dated, rates)))


def rank_trips(
    trips: DataFrame, labels: Sequence[str], order_by: Sequence[str] = ("report_key",)
) -> Ranked:
    """Encoded trips with a known total, in order; this writes them once.

    A trip without dates has no total and can train neither model. The trip key
    always ends the order, so ties do not depend on how rows arrive, and a day
    with very many trips is spread over several ranges.
    """
    known = trips.filter(F.col("y").isNotNull())
    order = [c for c in order_by if c != "report_key"] + ["report_key"]
    return rank_rows(with_category_index(known, labels), *order, name="trips")
