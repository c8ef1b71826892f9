"""Small hand-made inputs."""

from __future__ import annotations

import random
from datetime import date, timedelta

LINE_SCHEMA = (
    "report_key long, row_ord long, start_date_raw string, end_date_raw string, "
    "home_country string, dest_country string, expense_type string, amount_eur double"
)


def lines(spark, *rows):
    """Rows of (key, type, amount) plus optional overrides; order is given order."""
    full = []
    for i, (key, kind, amount, *rest) in enumerate(rows):
        extra = {
            "start": "20230101",
            "end": "20230103",
            "home": "SE",
            "dest": "PL",
            **(rest[0] if rest else {}),
        }
        full.append(
            (key, i, extra["start"], extra["end"], extra["home"], extra["dest"], kind, amount)
        )
    return spark.createDataFrame(full, LINE_SCHEMA)


def planted_trips(spark, n, seed=7, codes=("AA", "BB", "CC", "DD"), noise=1.0):
    """Trips whose total is a known function of duration, countries and season."""
    rng = random.Random(seed)
    rows = []
    for key in range(n):
        day = date(2020, 1, 1) + timedelta(days=(key * 3) % 1400)
        duration = rng.randint(1, 20)
        home, dest = rng.randrange(len(codes)), rng.randrange(len(codes))
        total = 500.0 + 40.0 * duration + 100.0 * home - 60.0 * dest + rng.gauss(0, noise)
        rows.append(
            (key, day, codes[home], codes[dest], duration, total / 2, 0.0, 0.0, total / 2, total)
        )
    return spark.createDataFrame(
        rows,
        "report_key long, ds date, home_country string, dest_country string, duration int, "
        "y_hotel double, y_air_ticket double, y_others double, y_daily_allowance double, y double",
    )
