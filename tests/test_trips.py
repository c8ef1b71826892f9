import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from fixtures import lines
from tripledger.operators import allowance, rollup
from tripledger.operators.metrics import category_shares
from tripledger.plans.trips import build_trips
from tripledger.sources import adapter, files
from tripledger.sources.countries import builtin_countries, builtin_rates

# A ten-line expense file and the ten trips it makes.
SAMPLE = """\
"Currency key","Currency key Name","Report Country","Report Domestic / International Flag","Report End Date","Report Entry Expense Type Name","Report Home Country Name","Report Key","Report Start Date","Amount in EUR"
"CNY","Renmimbi","CN","DOMESTIC","20230920","HOTEL","CN","0002535840","20230919",29.493332474148062
"SEK","Swedish Krona","CN","FOREIGN","20250316","DAILY ALLOWANCE","SE","0002933778","20250226",44.16241722405059
"BRL","Real","US","FOREIGN","20240518","DAILY ALLOWANCE","BR","0002760466","20240511",113.46021607622377
"CNY","Renmimbi","CN","DOMESTIC","20250909","TAXI","CN","0003202327","20250908",6.174104442201113
"IDR","Rupiah","ID","DOMESTIC","20231204","FUEL","ID","0002604799","20231106",32.56110040170455
"INR","Rupee","SG","FOREIGN","20240630","TAXI","IN","0002756881","20240501",56.34419697134847
"EUR","Euro","ES","DOMESTIC","20240607","DAILY ALLOWANCE","ES","0002781108","20240603",2.66
"INR","Rupee","SE","FOREIGN","20230701","HOTEL","IN","0002430503","20230415",76.63231385378947
"EUR","Euro","GB","FOREIGN","20230527","DAILY ALLOWANCE","IT","0002466824","20230523",18
"SEK","Swedish Krona","PL","FOREIGN","20240918","DAILY ALLOWANCE","SE","0002872096","20240916",20.221221845095037
"""
GOLDEN = [
    (2430503, "2023-04-15", "IN", "SE", 77, 76.6323, 0, 0, 3850, 3926.6323),
    (2466824, "2023-05-23", "IT", "GB", 4, 0, 0, 0, 380, 380),
    (2535840, "2023-09-19", "CN", "CN", 1, 29.4933, 0, 0, 80, 109.4933),
    (2604799, "2023-11-06", "ID", "ID", 28, 0, 0, 32.5611, 1680, 1712.5611),
    (2756881, "2024-05-01", "IN", "SG", 60, 0, 0, 56.3442, 3000, 3056.3442),
    (2760466, "2024-05-11", "BR", "US", 7, 0, 0, 0, 490, 490),
    (2781108, "2024-06-03", "ES", "ES", 4, 0, 0, 0, 380, 380),
    (2872096, "2024-09-16", "SE", "PL", 2, 0, 0, 0, 180, 180),
    (2933778, "2025-02-26", "SE", "CN", 18, 0, 0, 0, 1620, 1620),
    (3202327, "2025-09-08", "CN", "CN", 1, 0, 0, 6.1741, 80, 86.1741),
]


@pytest.fixture
def sample(spark, tmp_path):
    (tmp_path / "lines.csv").write_text(SAMPLE)
    return files.scan_expense_lines(spark, str(tmp_path / "lines.csv"))


def test_sample_file_gives_the_golden_trips(spark, sample):
    trips = build_trips(sample, builtin_rates(spark)).orderBy("report_key").collect()
    assert len(trips) == len(GOLDEN)
    for row, want in zip(trips, GOLDEN):
        assert (row.report_key, str(row.ds), row.home_country, row.dest_country, row.duration) == want[:5]
        found = (row.y_hotel, row.y_air_ticket, row.y_others, row.y_daily_allowance, row.y)
        assert found == pytest.approx(want[5:], abs=1e-4)


def test_staged_trips_equal_lazy_trips(spark, sample):
    rates = builtin_rates(spark)
    lazy = build_trips(sample, rates, staged=False).orderBy("report_key").collect()
    assert build_trips(sample, rates).orderBy("report_key").collect() == lazy


def test_golden_training_shares(spark, sample):
    trips = build_trips(sample, builtin_rates(spark)).orderBy("report_key").limit(8)
    shares = category_shares(trips).first().asDict()
    assert shares["Accommodation"] == pytest.approx(0.010369, abs=1e-6)
    assert shares["Air Ticket"] == 0
    assert shares["Daily Allowance"] == pytest.approx(0.980945, abs=1e-6)
    assert shares["Others"] == pytest.approx(0.008686, abs=1e-6)


def test_shares_of_a_zero_total_are_null(spark):
    zero = spark.createDataFrame(
        [(0.0,) * 5], "y_air_ticket double, y_hotel double, y_daily_allowance double, y_others double, y double"
    )
    assert set(category_shares(zero).first().asDict().values()) == {None}


def test_builtin_tables(spark):
    rates, countries = builtin_rates(spark), builtin_countries(spark)
    values = sorted(r.daily_allowance for r in rates.collect())
    assert (len(values), values[0], values[38], values[-1]) == (77, 40, 80, 125)
    assert allowance.check_rates(rates) == 77
    assert [r.country for r in rates.collect()] == sorted(r.code for r in countries.collect())


def test_line_order_follows_the_file_across_blocks(spark, tmp_path):
    """Blocks far smaller than the file; the first known value is the file's first."""
    header = SAMPLE.splitlines()[0]
    rows = [
        f'"EUR","Euro","D{i:05d}","FOREIGN","20230103","HOTEL","SE","{i % 7}","20230101",1.5'
        for i in range(4000)
    ]
    (tmp_path / "big.csv").write_text("\n".join([header, *rows]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scanned = files.scan_expense_lines(spark, str(tmp_path / "big.csv"))
        assert scanned.rdd.getNumPartitions() > 4
        meta = rollup.trip_meta(scanned).orderBy("report_key").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [m.dest_country for m in meta] == [f"D{i:05d}" for i in range(7)]


def test_header_in_another_order_is_rejected(spark, tmp_path):
    header = SAMPLE.splitlines()[0].split(",")
    (tmp_path / "swapped.csv").write_text(
        ",".join([header[1], header[0], *header[2:]]) + "\n" + SAMPLE.splitlines()[1] + "\n"
    )
    with pytest.raises(Exception, match="(?i)header"):
        files.scan_expense_lines(spark, str(tmp_path / "swapped.csv")).collect()


def test_missing_and_not_a_number_amounts_are_null(spark, tmp_path):
    rows = ['"EUR","Euro","PL","FOREIGN","20230103","HOTEL","NA","1","20230101",NaN',
            '"EUR","Euro","PL","FOREIGN","20230103","HOTEL","NA","1","20230101",']
    (tmp_path / "l.csv").write_text("\n".join([SAMPLE.splitlines()[0], *rows]) + "\n")
    found = files.scan_expense_lines(spark, str(tmp_path / "l.csv")).collect()
    assert [r.amount_eur for r in found] == [None, None]
    assert found[0].home_country == "NA"


def test_null_key_makes_no_trip(spark):
    df = lines(spark, (None, "HOTEL", 1.0), (5, "HOTEL", 2.0))
    assert [r.report_key for r in rollup.roll_up(df).collect()] == [5]


def test_unknown_types_are_others(spark):
    df = lines(spark, (1, None, 1.0), (1, "hotel", 2.0), (1, "FUEL", 4.0), (1, "HOTEL", 8.0))
    row = rollup.pivot_expenses(df).first()
    assert (row.y_others, row.y_hotel, row.y_air_ticket) == (7.0, 8.0, 0.0)


def test_first_known_value_is_per_column(spark):
    df = lines(
        spark,
        (1, "HOTEL", 1.0, {"dest": None, "start": "20230105"}),
        (1, "HOTEL", 1.0, {"dest": "SE", "home": None, "start": None}),
        (1, "HOTEL", 1.0, {"dest": "GB", "home": "IT"}),
        (2, "HOTEL", 1.0, {"dest": None}),
        (3, "HOTEL", 1.0, {"home": "A"}),
        (3, "HOTEL", 1.0, {"home": "B", "dest": None}),
    )
    meta = {r.report_key: r for r in rollup.trip_meta(df).collect()}
    assert (meta[1].dest_country, meta[1].home_country, meta[1].start_date_raw) == ("SE", "SE", "20230105")
    assert (meta[2].dest_country, meta[2].home_country) == (None, "SE")
    assert meta[3].home_country == "A"


def test_first_known_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    pick = lambda *v: rng.choice([None, *v])
    rows = [
        (rng.randrange(40), "HOTEL", 1.0,
         {"home": pick("A", "B"), "dest": pick("C", "D"), "start": pick("20230101"), "end": pick("20230102", "20230109")})
        for _ in range(400)
    ]
    want = {}
    for key, _, _, facts in rows:
        kept = want.setdefault(key, {})
        for name, value in facts.items():
            if value is not None:
                kept.setdefault(name, value)
    for r in rollup.trip_meta(lines(spark, *rows)).collect():
        found = {"home": r.home_country, "dest": r.dest_country, "start": r.start_date_raw, "end": r.end_date_raw}
        assert {k: v for k, v in found.items() if v is not None} == want[r.report_key]


def test_all_null_amounts_sum_to_zero(spark):
    row = rollup.roll_up(lines(spark, (1, "HOTEL", None), (1, "TAXI", None))).first()
    assert (row.y_hotel, row.y_air_ticket, row.y_others) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize(
    "start, end, days",
    [("20230101", "20230101", 1), ("20230105", "20230101", 1), ("20230101", "20230104", 3), ("20230101", None, None)],
)
def test_duration(spark, start, end, days):
    df = lines(spark, (1, "HOTEL", 10.0, {"start": start, "end": end}))
    trip = build_trips(df, builtin_rates(spark)).first()
    assert trip.duration == days
    assert (trip.y is None) == (days is None)


def test_impossible_date_is_an_error_or_null_on_request(spark):
    df = lines(spark, (1, "HOTEL", 1.0, {"start": "20230230"}))
    with pytest.raises(Exception):
        build_trips(df, builtin_rates(spark)).collect()
    assert build_trips(df, builtin_rates(spark), quarantine=True).first().ds is None


def test_missing_rate_gets_the_trip_weighted_median(spark):
    df = lines(
        spark,
        *[(k, "HOTEL", 0.0, {"home": "US"}) for k in (1, 2, 3)],
        (4, "HOTEL", 0.0, {"home": "BD"}),
        (5, "HOTEL", 0.0, {"home": "ZZ"}),
        (6, "HOTEL", 0.0, {"home": "SE"}),
    )
    trips = {r.report_key: r for r in build_trips(df, builtin_rates(spark)).collect()}
    assert trips[5].y_daily_allowance == 100.0 * 2  # median of 100, 100, 100, 40, 90


def test_median_interpolates(spark):
    df = lines(spark, (1, "HOTEL", 0.0, {"home": "BD"}), (2, "HOTEL", 0.0, {"home": "US"}),
               (3, "HOTEL", 0.0, {"home": "ZZ"}))
    rated = allowance.join_rates(rollup.roll_up(df), builtin_rates(spark))
    assert allowance.rate_median(rated).first()[0] == 70.0


def test_null_country_matches_a_null_rate(spark):
    rates = spark.createDataFrame([(None, 7.0), ("SE", 90.0)], "country string, daily_allowance double")
    df = lines(spark, (1, "HOTEL", 0.0, {"home": None}))
    assert build_trips(df, rates).first().y_daily_allowance == 14.0


def test_two_rates_for_a_country_are_rejected(spark):
    rates = spark.createDataFrame([("CN", 1.0), ("CN", 2.0)], "country string, daily_allowance double")
    with pytest.raises(ValueError, match="2 rows for 1"):
        build_trips(lines(spark, (1, "HOTEL", 1.0)), rates)


def test_a_rate_table_is_broadcast_by_its_measured_size_only(spark):
    df = lines(spark, *[(k, "HOTEL", 1.0, {"home": "SE" if k % 3 else "US"}) for k in range(30)])
    want = build_trips(df, builtin_rates(spark)).orderBy("report_key").collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = build_trips(df, builtin_rates(spark)).orderBy("report_key")
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        assert shuffled.collect() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_amounts_that_are_no_numbers_count_as_missing(spark):
    trip = build_trips(lines(spark, (1, "HOTEL", float("nan")), (1, "HOTEL", 2.0)), builtin_rates(spark))
    assert trip.first().y_hotel == 2.0


def test_a_hot_trip_key_is_reduced_before_the_shuffle(spark):
    """A third of all lines on one key: at most one state per task and key is shuffled."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).cast("long").alias("report_key"),
        F.col("id").alias("row_ord"),
        F.lit("20230101").alias("start_date_raw"),
        F.lit("20230102").alias("end_date_raw"),
        F.lit("SE").alias("home_country"),
        F.concat(F.lit("D"), F.col("id")).alias("dest_country"),
        F.lit("HOTEL").alias("expense_type"),
        F.lit(1.0).alias("amount_eur"),
    )
    rolled = rollup.roll_up(df)
    hot = rolled.filter("report_key = -1").first()
    assert (hot.y_hotel, hot.dest_country) == (10_000.0, "D0")
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan


def test_rates_and_requests_files(spark, tmp_path):
    rates = builtin_rates(spark)
    for fmt in ("csv", "parquet"):
        files.write_rates(rates, str(tmp_path / fmt), fmt)
        back = files.scan_rates(spark, str(tmp_path / fmt), fmt)
        assert sorted(back.collect()) == sorted(rates.collect())
    (tmp_path / "q.csv").write_text("home_country,dest_country,num_days,month,year\nSE,PL,3,4,\n")
    row = files.scan_requests(spark, str(tmp_path / "q.csv")).first()
    assert tuple(row) == ("SE", "PL", 3, 4, None)


HEADER = "home_country,dest_country,num_days,month,year\n"


@pytest.mark.parametrize(
    "scan, text",
    [
        (files.scan_rates, "country,daily_allowance\nSE,abc\n"),
        (files.scan_rates, "country,daily_allowance\nSE,95 EUR\n"),
        (files.scan_rates, "country,daily_allowance\nSE,1,2\n"),
        (files.scan_rates, "daily_allowance,country\n1,SE\n"),
        (files.scan_requests, "dest_country,home_country,num_days,month,year\nSE,PL,1,2,2025\n"),
        (files.scan_requests, HEADER + "SE,PL,three,2,2025\n"),
    ],
)
def test_bad_rows_and_headers_are_errors(spark, tmp_path, scan, text):
    (tmp_path / "f.csv").write_text(text)
    with pytest.raises(Exception):
        scan(spark, str(tmp_path / "f.csv")).collect()


def test_bad_rows_can_be_set_aside(spark, tmp_path):
    (tmp_path / "f.csv").write_text(HEADER + "SE,PL,3,2,2025\nSE,PL,x,2,\nSE,PL,1,13.5,\nSE,PL,1\n")
    rejects = str(tmp_path / "rejects")
    kept = files.scan_requests(spark, str(tmp_path / "f.csv"), rejects=rejects)
    assert [tuple(r) for r in kept.collect()] == [("SE", "PL", 3, 2, 2025)]
    assert files.count_rejects(spark, rejects) == 3
    # A column that a query does not use still decides.
    assert files.scan_requests(
        spark, str(tmp_path / "f.csv"), rejects=rejects
    ).select("home_country").count() == 1


def test_rates_may_have_the_headers_of_a_spreadsheet(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Country,Daily_Allowance\nSE,90\n")
    assert tuple(files.scan_rates(spark, str(tmp_path / "r.csv")).first()) == ("SE", 90.0)


def test_lines_with_text_keys_are_not_lost(spark, tmp_path):
    files.write_expense_lines(
        lines(spark, (1, "HOTEL", 1.0), (2, "HOTEL", 2.0)).withColumns(
            {"report_key": F.concat(F.lit("A"), "report_key"), "currency_key": F.lit("EUR"),
             "currency_name": F.lit("Euro"), "dom_intl_flag": F.lit("FOREIGN")}
        ),
        str(tmp_path / "l"),
    )
    with pytest.raises(Exception, match="bad row"):
        files.scan_expense_lines(spark, str(tmp_path / "l")).select("report_key").collect()


def test_lines_without_partners_stay(spark, tmp_path):
    """An order line whose order and supplier are missing keeps its amount."""
    for name in ("orders", "customer", "supplier", "nation", "lineitem"):
        rows = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        (rows.limit(0) if name in ("orders", "supplier") else rows.limit(5)).write.parquet(
            str(tmp_path / f"{name}.parquet")
        )
    found = adapter.expense_lines(spark, str(tmp_path)).collect()
    assert len(found) == 5 and all(r.home_country is None and r.amount_eur > 0 for r in found)
