"""Schemas of the input tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Header of the expense-line files and our name for each column.
EXPENSE_LINE_COLUMNS = {
    "Currency key": "currency_key",
    "Currency key Name": "currency_name",
    "Report Country": "dest_country",
    "Report Domestic / International Flag": "dom_intl_flag",
    "Report End Date": "end_date_raw",
    "Report Entry Expense Type Name": "expense_type",
    "Report Home Country Name": "home_country",
    "Report Key": "report_key",
    "Report Start Date": "start_date_raw",
    "Amount in EUR": "amount_eur",
}

EXPENSE_LINE_FILE = T.StructType(
    [
        T.StructField(
            name,
            {"Report Key": T.LongType(), "Amount in EUR": T.DoubleType()}.get(name, T.StringType()),
        )
        for name in EXPENSE_LINE_COLUMNS
    ]
)

RATE = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("daily_allowance", T.DoubleType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("home_country", T.StringType()),
        T.StructField("dest_country", T.StringType()),
        T.StructField("num_days", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
    ]
)

TRIP_COLUMNS = (
    "report_key",
    "ds",
    "home_country",
    "dest_country",
    "duration",
    "y_hotel",
    "y_air_ticket",
    "y_others",
    "y_daily_allowance",
    "y",
)
