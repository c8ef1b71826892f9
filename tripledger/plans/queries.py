"""Every operator as a query over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions.trip import (
    expense_category,
    month_name,
    parse_day,
    trip_days,
)
from tripledger.models import additive as additive_model
from tripledger.models.bundle import load, load_or_train, newest_run, save
from tripledger.models.hybrid import (
    HybridModel,
    evaluate,
    fit_hybrid,
    forecast,
    future_rows,
    predict_hold_out,
    tail_steps,
    with_request_window,
)
from tripledger.models.lagged import fit_lagged
from tripledger.models.origins import evaluate_origins, even_origins
from tripledger.models.recurrent import fit_recurrent
from tripledger.models.sequence import scaled_step
from tripledger.operators import allowance, encode, metrics, ranks, rollup, windows
from tripledger.operators.scaling import MinMax
from tripledger.plans.training import Training, run_training
from tripledger.plans.trips import build_trips, price_trips, rank_trips
from tripledger.session import apply_runtime_defaults, scratch_path, stage
from tripledger.sources import adapter, files
from tripledger.sources.countries import COUNTRY_CODES, builtin_rates
from tripledger.sources.trip_store import TripStore
from tripledger.streaming.scoring import score_stream, score_stream_with_newest


class Tables:
    """The inputs of one query and the stages it may start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_runtime_defaults(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return adapter.table(self.spark, self.sf_dir, name)

    @cached_property
    def lines(self) -> DataFrame:
        return adapter.expense_lines(self.spark, self.sf_dir)

    @cached_property
    def amounts(self) -> DataFrame:
        return adapter.amount_lines(self.spark, self.sf_dir)

    @cached_property
    def rates(self) -> DataFrame:
        return adapter.rates(self.spark, self.sf_dir)

    @cached_property
    def countries(self) -> DataFrame:
        return adapter.countries(self.spark, self.sf_dir)

    @cached_property
    def requests(self) -> DataFrame:
        return adapter.requests(self.spark, self.sf_dir)

    @cached_property
    def labels(self) -> list[str]:
        return encode.domain_of(self.countries)

    @cached_property
    def dated(self) -> DataFrame:
        return rollup.with_dates(rollup.roll_up(self.lines))

    @cached_property
    def rated(self) -> DataFrame:
        return allowance.join_rates(self.dated, self.rates)

    @cached_property
    def trips(self) -> DataFrame:
        return build_trips(self.lines, self.rates)

    @cached_property
    def ranked(self) -> ranks.Ranked:
        return rank_trips(build_trips(self.lines, self.rates), self.labels)

    @cached_property
    def train_rows(self) -> int:
        return ranks.train_size(self.ranked.count)

    @cached_property
    def train(self) -> DataFrame:
        return self.ranked.before(self.train_rows)

    @cached_property
    def test(self) -> DataFrame:
        return self.ranked.since(self.train_rows)

    @cached_property
    def recent(self) -> DataFrame:
        """The last training rows; only their files are read."""
        first = max(self.train_rows - windows.SEQUENCE_LENGTH, 0)
        return self.ranked.since(first).filter(F.col("rn") < self.train_rows)

    @cached_property
    def scaler(self) -> MinMax:
        return MinMax.fit(self.train, self.labels)

    def training(self, **options) -> Training:
        return run_training(self.lines, self.rates, self.countries, **options)


def scan_expense_lines(t: Tables) -> DataFrame:
    """Lines written as CSV and scanned back."""
    path = scratch_path(t.spark, "lines")
    files.write_expense_lines(t.lines, path)
    return files.scan_expense_lines(t.spark, path).drop("row_ord")


def scan_rejects(t: Tables) -> DataFrame:
    """Lines of every 50th trip written with a bad key or amount: kept and rejected ones."""
    path, rejects = scratch_path(t.spark, "lines"), scratch_path(t.spark, "rejects")
    turn = F.col("report_key") % 50
    bad = t.lines.withColumns(
        {
            "report_key": F.when(turn == 0, F.concat(F.lit("A"), "report_key")).otherwise(
                F.col("report_key").cast("string")
            ),
            "amount_eur": F.when(turn == 1, "1,234.5").otherwise(
                F.col("amount_eur").cast("string")
            ),
        }
    )
    files.write_expense_lines(bad, path)
    kept = files.scan_expense_lines(t.spark, path, rejects)
    return kept.agg(
        F.count(F.lit(1)).alias("n_kept"), F.round(F.sum("amount_eur"), 0).alias("amount_eur")
    ).withColumn("n_rejected", F.lit(files.count_rejects(t.spark, rejects)).cast("long"))


def scan_requests(t: Tables) -> DataFrame:
    """Requests written as CSV and scanned back."""
    path = scratch_path(t.spark, "requests")
    t.requests.drop("request_id").write.csv(path, header=True)
    return files.scan_requests(t.spark, path)


def _customer_homes(t: Tables) -> DataFrame:
    return (
        t.table("customer")
        .join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("home_country"))
    )


def scan_rates(t: Tables) -> DataFrame:
    """Rates written as CSV, scanned back and looked up for every customer."""
    path = scratch_path(t.spark, "rates")
    files.write_rates(t.rates, path)
    return allowance.join_rates(_customer_homes(t), files.scan_rates(t.spark, path))


def builtin_rates_query(t: Tables) -> DataFrame:
    """The built-in rates looked up for every customer, dealt out over the sorted codes."""
    code = F.get(F.array(*(F.lit(c) for c in sorted(COUNTRY_CODES))), (F.col("c_custkey") % 77).cast("int"))
    homes = t.table("customer").select("c_custkey", code.alias("home_country"))
    rated = allowance.join_rates(homes, builtin_rates(t.spark))
    return rated.withColumnRenamed("home_country", "country")


def rates_roundtrip(t: Tables) -> DataFrame:
    """Rates written as Parquet, read back, with the customers of each country."""
    path = scratch_path(t.spark, "rates")
    files.write_rates(t.rates, path, "parquet")
    rates = files.scan_rates(t.spark, path, "parquet")
    customers = _customer_homes(t).groupBy("home_country").agg(F.count("*").alias("n_customers"))
    return rates.join(customers, rates.country == customers.home_country, "left").select(
        "country", "daily_allowance", F.coalesce("n_customers", F.lit(0)).alias("n_customers")
    )


def country_dim(t: Tables) -> DataFrame:
    customers = _customer_homes(t).groupBy("home_country").agg(F.count("*").alias("n_customers"))
    return t.countries.join(
        customers, t.countries.code == customers.home_country, "left"
    ).select("code", "name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"))


def country_list(t: Tables) -> DataFrame:
    """Sorted domain with the suppliers of each country."""
    domain = t.spark.createDataFrame(list(enumerate(t.labels)), "position int, code string")
    suppliers = (
        t.table("supplier")
        .join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.count("*").alias("n_suppliers"))
    )
    return domain.join(suppliers, domain.code == suppliers.n_name, "left").select(
        "position", "code", F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers")
    )


def month_dim(t: Tables) -> DataFrame:
    """Months of the request form with the trips that start in each."""
    months = t.spark.range(1, 13).select(
        F.col("id").cast("int").alias("month"), month_name(F.col("id").cast("int")).alias("name")
    )
    started = (
        t.table("orders")
        .groupBy(F.month("o_orderdate").alias("month"))
        .agg(F.count("*").alias("n_trips"))
    )
    return months.join(started, "month", "left").select(
        "month", "name", F.coalesce("n_trips", F.lit(0)).alias("n_trips")
    )


def expense_category_query(t: Tables) -> DataFrame:
    return t.amounts.select(
        "report_key",
        "expense_type",
        F.col("amount_eur").cast("double").alias("amount_eur"),
        expense_category(F.col("expense_type")).alias("category"),
    )


def drop_null_key(t: Tables) -> DataFrame:
    """Every tenth trip key is blanked, then the key filter is applied."""
    key = F.when(F.col("report_key") % 10 != 0, F.col("report_key"))
    return rollup.keyed_lines(t.amounts.withColumn("report_key", key)).select(
        "report_key", F.col("amount_eur").cast("double").alias("amount_eur")
    )


def _line_dates(t: Tables) -> DataFrame:
    return t.lines.select(
        "report_key",
        parse_day(F.col("start_date_raw")).alias("start_date"),
        parse_day(F.col("end_date_raw")).alias("end_date"),
    )


def trip_duration(t: Tables) -> DataFrame:
    """Duration both ways round: the reversed dates exercise the floor."""
    return _line_dates(t).select(
        "report_key",
        trip_days(F.col("start_date"), F.col("end_date")).alias("duration"),
        trip_days(F.col("end_date"), F.col("start_date")).alias("reversed_duration"),
    )


def trip_rollup(t: Tables) -> DataFrame:
    return rollup.roll_up(t.lines)


def allowance_left_join(t: Tables) -> DataFrame:
    return t.rated.select("report_key", "home_country", "daily_allowance")


def rate_median_fill(t: Tables) -> DataFrame:
    """Both the trips and their median come from one written roll-up."""
    rated = allowance.join_rates(stage(t.dated, "rollup"), t.rates)
    return allowance.fill_rates(rated).select("report_key", "home_country", "daily_allowance")


def trip_allowance(t: Tables) -> DataFrame:
    return t.trips.select("report_key", "duration", "y_daily_allowance")


def category_index(t: Tables) -> DataFrame:
    return encode.with_category_index(rollup.trip_meta(t.lines), t.labels).select(
        "report_key", "home_idx", "dest_idx"
    )


def one_hot_wide(t: Tables) -> DataFrame:
    meta = rollup.trip_meta(t.lines).select("report_key", "home_country", "dest_country")
    return encode.one_hot_wide(meta, t.labels)


def feature_frame(t: Tables) -> DataFrame:
    wide = encode.one_hot_wide(t.trips, t.labels)
    return wide.select("report_key", *encode.feature_names(wide.columns, with_target=True))


def country_lookup(t: Tables) -> DataFrame:
    meta = rollup.trip_meta(t.lines).select("report_key", "dest_country")
    return encode.with_country_names(meta, "dest_country", t.countries, "dest_name")


def global_rank(t: Tables) -> DataFrame:
    return t.ranked.rows.select("rn", "report_key")


def ordered_split(t: Tables) -> DataFrame:
    return ranks.with_split(t.ranked).select("report_key", "rn", "is_train")


def guard_counts(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    rows = t.train_rows
    return t.ranked.rows.agg(
        n.alias("n"),
        F.count_if(F.col("rn") < rows).alias("n_train"),
        F.count_if(F.col("rn") >= rows).alias("n_test"),
        F.count_if(F.col("rn").between(windows.SEQUENCE_LENGTH, rows - 1)).alias("n_sequences"),
    ).withColumn("fits_sequence", F.col("n_sequences") > 0)


def union_train_test(t: Tables) -> DataFrame:
    columns = ["report_key", "y", "duration", "home_idx", "dest_idx"]
    return (
        t.train.select(*columns)
        .withColumn("is_train", F.lit(True))
        .unionByName(t.test.select(*columns).withColumn("is_train", F.lit(False)))
    )


def history_tail(t: Tables) -> DataFrame:
    return t.recent.select("rn", "report_key", "y", "duration")


def category_shares(t: Tables) -> DataFrame:
    shares = metrics.category_shares(t.train)
    return shares.select(
        *[
            F.round(F.col(f"`{item}`"), 9).alias(item.lower().replace(" ", "_"))
            for item in metrics.COST_ITEMS
        ]
    )


def minmax_fit(t: Tables) -> DataFrame:
    return t.scaler.table(t.spark)


def minmax_transform(t: Tables) -> DataFrame:
    s = t.scaler
    return t.ranked.rows.select(
        "report_key",
        F.round(s.scale("y", F.col("y")), 9).alias("y_scaled"),
        F.round(s.scale("duration", F.col("duration")), 9).alias("duration_scaled"),
        s.scaled_slot("home", t.labels).alias("home_scaled"),
        s.scaled_slot("dest", t.labels).alias("dest_scaled"),
    )


def minmax_inverse(t: Tables) -> DataFrame:
    restored = t.scaler.restore("y", t.scaler.scale("y", F.col("y")))
    return t.ranked.rows.select("report_key", F.round(restored, 2).alias("y_restored"))


def _raw_step() -> Column:
    return windows.step(F.col("y"), F.col("duration"), F.col("home_idx"), F.col("dest_idx"))


def _total(values: Column, digits: int) -> Column:
    return F.round(F.aggregate(values, F.lit(0.0), lambda total, v: total + v), digits)


def _window_summary(df: DataFrame, key: str, digits: int) -> DataFrame:
    """What identifies a window without listing all its steps."""
    first, last = F.get("history", F.lit(0)), F.element_at("history", -1)
    positions = F.transform(
        F.col("history"),
        lambda s: (F.coalesce(s["home_idx"], F.lit(-1)) * 100 + F.coalesce(s["dest_idx"], F.lit(-1))).cast("double"),
    )
    return df.select(
        key,
        F.size("history").alias("n_steps"),
        F.round(first["y"], digits).alias("first_y"),
        F.round(last["y"], digits).alias("last_y"),
        _total(F.col("history.y"), digits).alias("sum_y"),
        _total(F.col("history.duration"), digits).alias("sum_duration"),
        _total(positions, 0).alias("sum_positions"),
    )


def sequence_windows(t: Tables) -> DataFrame:
    return _window_summary(windows.with_history(t.train, _raw_step(), t.train_rows), "rn", 2)


def eval_windows(t: Tables) -> DataFrame:
    """Windows of the hold-out over training and hold-out rows together."""
    first, length = t.train_rows, windows.SEQUENCE_LENGTH
    context = t.ranked.since(first - length)
    rows = t.ranked.count - first + length
    found = windows.with_history(context, _raw_step(), rows).filter(F.col("rn") >= first)
    return _window_summary(found, "rn", 2)


def future_rows_query(t: Tables) -> DataFrame:
    return future_rows(t.requests, t.labels).select(
        "request_id", "ds", "duration", "home_idx", "dest_idx"
    )


def future_window(t: Tables) -> DataFrame:
    found = with_request_window(
        future_rows(t.requests, t.labels), tail_steps(t.recent, t.scaler), t.scaler
    )
    return _window_summary(found, "request_id", 6)


def _stand_in_predictions(t: Tables) -> DataFrame:
    """Two computed columns in place of predictions, matched and averaged."""
    first = t.test.select("report_key", "y", (F.col("y_hotel") + F.col("y_air_ticket")).alias("additive"))
    second = t.test.select(
        "report_key", (F.col("y_others") + F.col("y_daily_allowance")).alias("sequence")
    )
    return metrics.align_predictions(first, second, "report_key")


def hybrid_average(t: Tables) -> DataFrame:
    return _stand_in_predictions(t).select(
        "report_key", "additive", "sequence", F.round("hybrid", 3).alias("hybrid")
    )


def error_metrics(t: Tables) -> DataFrame:
    return metrics.error_metrics(_stand_in_predictions(t), "y", "hybrid").select(
        F.round("rmse", 4).alias("rmse"), F.round(F.col("mse") / 1000, 1).alias("mse_thousands")
    )


def breakdown_long(t: Tables) -> DataFrame:
    """Hold-out totals split by the training shares."""
    shares = metrics.category_shares(t.train).first().asDict()
    split = t.test.select("report_key", metrics.breakdown(F.col("y"), shares).alias("breakdown"))
    return metrics.breakdown_long(split, ["report_key"])


def forecast_series(t: Tables) -> DataFrame:
    wide = _stand_in_predictions(t).withColumn("total", F.round("hybrid", 3))
    return metrics.forecast_series(wide, ["report_key"])


def calendar_features(t: Tables) -> DataFrame:
    """Seasonal columns of every training day."""
    columns = []
    for name, period, orders in (additive_model.YEARLY, additive_model.WEEKLY):
        for order in range(1, orders + 1):
            sine, cosine = additive_model.season(period, order)
            columns += [
                F.round(F.expr(sine), 6).alias(f"{name}_sin_{order}"),
                F.round(F.expr(cosine), 6).alias(f"{name}_cos_{order}"),
            ]
    return t.train.select("ds").distinct().select("ds", *columns)


def trend_hinges(t: Tables) -> DataFrame:
    """Trend and changepoint columns of every training day."""
    calendar = additive_model.fit_calendar(t.train)
    hinges = [
        F.round(F.expr(additive_model.hinge(point, calendar)), 6).alias(f"hinge_{j}")
        for j, point in enumerate(calendar.changepoints, 1)
    ]
    trend = F.round(F.expr(additive_model.trend(calendar)), 6).alias("trend")
    return t.train.select("ds").distinct().select("ds", trend, *hinges)


def additive_fit(t: Tables) -> DataFrame:
    model = additive_model.fit_additive(t.train, t.labels)
    return t.spark.createDataFrame(model.coefficients(), "feature string, coefficient double")


def additive_predict(t: Tables) -> DataFrame:
    model = additive_model.fit_additive(t.train, t.labels)
    return model.transform(t.test).select("report_key", "ds", "y", "additive")


def sequence_fit(t: Tables) -> DataFrame:
    """Error of the sequence model on the windows it was fitted on."""
    model = fit_lagged(t.train, t.train_rows, t.labels, t.scaler)
    found = windows.with_history(t.train, scaled_step(t.scaler), t.train_rows)
    return metrics.error_metrics(model.transform(found), "y", "sequence")


def sequence_predict(t: Tables) -> DataFrame:
    model = fit_lagged(t.train, t.train_rows, t.labels, t.scaler)
    first, length = t.train_rows, windows.SEQUENCE_LENGTH
    context = t.ranked.since(first - length)
    found = windows.with_history(context, scaled_step(t.scaler), t.ranked.count - first + length)
    return model.transform(found.filter(F.col("rn") >= first)).select("report_key", "y", "sequence")


def recurrent_predict(t: Tables) -> DataFrame:
    """Hold-out predictions of the recurrent learner."""
    model = fit_recurrent(t.train, t.train_rows, t.labels, t.scaler)
    first, length = t.train_rows, windows.SEQUENCE_LENGTH
    context = t.ranked.since(first - length)
    found = windows.with_history(context, scaled_step(t.scaler), t.ranked.count - first + length)
    return model.transform(found.filter(F.col("rn") >= first)).select("report_key", "y", "sequence")


def hybrid_fit(t: Tables) -> DataFrame:
    done = t.training()
    return predict_hold_out(done.model, done.ranked).select(
        "report_key", "y", "additive", "sequence", "predicted"
    )


def evaluate_hybrid(t: Tables) -> DataFrame:
    return t.training().metrics


def _flat(forecasts: DataFrame, *others: Column) -> DataFrame:
    """The breakdown as columns, which every client can hold."""
    return forecasts.select(
        "request_id",
        *others,
        "total",
        "additive",
        "sequence",
        *[
            F.col("breakdown")[item].alias(item.lower().replace(" ", "_"))
            for item in metrics.COST_ITEMS
        ],
    )


def forecast_query(t: Tables) -> DataFrame:
    return _flat(forecast(t.training().model, t.requests))


def fallback_forecast(t: Tables) -> DataFrame:
    return _flat(forecast(t.training(with_sequence=False).model, t.requests))


def additive_closed_form(t: Tables) -> DataFrame:
    """Hold-out predictions of a fit that is plain least squares.

    Without changepoints, seasons and countries, and with wide priors, the model is a linear function of the day and the duration.
    """
    model = additive_model.fit_additive(t.train, [], PLAIN)
    return model.transform(t.test).select("report_key", F.round("additive", 0).alias("additive"))


#: A trend and a duration without penalty, which SQL can fit.
PLAIN = additive_model.Settings(changepoints=0, trend_prior=1e6, regressor_prior=1e6, seasons=())


def _plain_hybrid(t: Tables, with_sequence: bool = True) -> HybridModel:
    """Plain least squares in both parts: no countries, and windows of one step."""
    return fit_hybrid(
        t.train, t.train_rows, [], settings=PLAIN, with_sequence=with_sequence, recent=t.recent,
        length=1, penalty=0.0,
    )


def _whole_euros(df: DataFrame, *kept: str) -> DataFrame:
    return df.select(*kept, *(F.round(c, 0).alias(c) for c in df.columns if c not in kept))


def sequence_closed_form(t: Tables) -> DataFrame:
    """Hold-out predictions of the window learner from one step before."""
    model = fit_lagged(t.train, t.train_rows, [], t.scaler, length=1, penalty=0.0)
    context = t.ranked.since(t.train_rows - 1)
    found = windows.with_history(context, scaled_step(t.scaler), t.ranked.count - t.train_rows + 1, 1)
    return _whole_euros(model.transform(found).select("report_key", "sequence"), "report_key")


def hybrid_closed_form(t: Tables) -> DataFrame:
    found = predict_hold_out(_plain_hybrid(t), t.ranked)
    return _whole_euros(found.select("report_key", "additive", "sequence", "predicted"), "report_key")


def evaluate_closed_form(t: Tables) -> DataFrame:
    return evaluate(_plain_hybrid(t), t.ranked).select(
        F.round("rmse", 2).alias("rmse"), F.round(F.col("mse") / 1000, 1).alias("mse_thousands")
    )


def forecast_closed_form(t: Tables) -> DataFrame:
    return _whole_euros(_flat(forecast(_plain_hybrid(t), t.requests)), "request_id")


def fallback_closed_form(t: Tables) -> DataFrame:
    return _whole_euros(_flat(forecast(_plain_hybrid(t, False), t.requests)), "request_id")


def stream_closed_form(t: Tables) -> DataFrame:
    """The closed form's forecasts, made by the stream."""
    return _whole_euros(_flat(_streamed(t, _plain_hybrid(t))), "request_id")


def bundle_closed_form(t: Tables) -> DataFrame:
    """The closed form's forecasts, made by a bundle that was saved and loaded."""
    path = scratch_path(t.spark, "bundle")
    save(_plain_hybrid(t), path)
    return _whole_euros(_flat(forecast(load(t.spark, path), t.requests)), "request_id")


def origins_closed_form(t: Tables) -> DataFrame:
    """Errors of the plain design from three origins."""
    origins = even_origins(t.ranked.count, 3)
    found = evaluate_origins(t.ranked, origins, [], PLAIN)
    return found.select(
        F.col("origin").cast("long").alias("origin"),
        "trips",
        F.round("rmse", 2).alias("rmse"),
        F.round("bias", 2).alias("bias"),
    )


def evaluate_from_origins(t: Tables) -> DataFrame:
    """Errors of the whole design from five origins."""
    return evaluate_origins(t.ranked, even_origins(t.ranked.count, 5), t.labels)


def _saved_and_loaded(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "bundle")
    fitted = t.training().model
    save(fitted, path)
    loaded = load_or_train(t.spark, path, train=lambda: fitted)
    before = forecast(fitted, t.requests).select(
        *t.requests.columns, F.col("total").alias("total_fitted")
    )
    return forecast(loaded, before).select(
        "request_id", "total_fitted", F.col("total").alias("total_loaded")
    )


def model_roundtrip(t: Tables) -> DataFrame:
    """Forecasts of the fitted model and of the one loaded from its bundle."""
    return _saved_and_loaded(t)


def bundle_equals_fit(t: Tables) -> DataFrame:
    """Every request has one forecast, the same before and after saving."""
    same = F.col("total_fitted") == F.col("total_loaded")
    return _saved_and_loaded(t).select("request_id", same.alias("same"))


def _streamed(t: Tables, model) -> DataFrame:
    """Customers arrive as a stream; their forecasts are appended to a table.

    The table may be one file or a folder of files.
    """
    source = t.spark.readStream.schema(t.table("customer").schema)
    customers = source.option("pathGlobFilter", "*.parquet").parquet(
        adapter.stream_folder(t.spark, t.sf_dir, "customer")
    )
    out = scratch_path(t.spark, "stream")
    requests = adapter.requests(t.spark, t.sf_dir, customers)
    score_stream(
        model, requests, f"{out}/forecasts", f"{out}/progress", available_now=True
    ).awaitTermination()
    return t.spark.read.parquet(f"{out}/forecasts")


def stream_forecast(t: Tables) -> DataFrame:
    return _flat(_streamed(t, t.training().model))


def stream_equals_batch(t: Tables) -> DataFrame:
    """Every request is scored once by the stream, as a batch would score it."""
    model = t.training(with_sequence=False).model
    path = scratch_path(t.spark, "forecasts")
    files.write_forecasts(forecast(model, t.requests), path)
    batch = t.spark.read.parquet(path).select("request_id", F.col("total").alias("batch_total"))
    return (
        _streamed(t, model)
        .join(batch, "request_id", "full")
        .select("request_id", F.col("total").eqNullSafe(F.col("batch_total")).alias("same"))
    )


def _store_of_batches(t: Tables) -> TripStore:
    """All lines in seven batches, dealt out by hash and so late or early alike.

    Two batches arrive twice, and levels are merged on the way.
    """
    lines = stage(t.lines, "lines")
    dealt = F.pmod(F.xxhash64("report_key", "row_ord"), F.lit(7))
    store = TripStore(t.spark, scratch_path(t.spark, "trips"), fan=3)
    for number in (4, 1, 6, 4, 0, 2, 5, 1, 3):
        store.append(lines.filter(dealt == number), f"batch {number}")
    return store


def trips_from_batches(t: Tables) -> DataFrame:
    return price_trips(_store_of_batches(t).rolled(), t.rates)


def rollup_from_batches(t: Tables) -> DataFrame:
    return _store_of_batches(t).rolled()


def stream_new_model(t: Tables) -> DataFrame:
    """Customers arrive in two parts; between them a new model is saved and the stream restarts.

    Even ones are scored by the first bundle, which has both parts, odd ones by
    the second, which is additive alone. ``model`` is the bundle's number.
    """
    base = scratch_path(t.spark, "renewed")
    customers = t.table("customer")
    odd = F.col("c_custkey") % 2 == 1
    runs = []
    for part, with_sequence in ((~odd, True), (odd, False)):
        save(_plain_hybrid(t, with_sequence), f"{base}/bundle")
        runs.append(newest_run(t.spark, f"{base}/bundle"))
        customers.filter(part).write.mode("append").parquet(f"{base}/customers")
        arriving = t.spark.readStream.schema(customers.schema).parquet(f"{base}/customers")
        score_stream_with_newest(
            t.spark, f"{base}/bundle", adapter.requests(t.spark, t.sf_dir, arriving),
            f"{base}/forecasts", f"{base}/progress", available_now=True,
        ).awaitTermination()
    found = t.spark.read.parquet(f"{base}/forecasts")
    number = F.when(F.col("model_run") == runs[0], 1).when(F.col("model_run") == runs[1], 2)
    return _whole_euros(_flat(found, number.alias("model")), "request_id", "model")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "trip_totals": lambda t: t.trips,
    "scan_expense_lines": scan_expense_lines,
    "scan_rejects": scan_rejects,
    "scan_requests": scan_requests,
    "scan_rates": scan_rates,
    "builtin_rates": builtin_rates_query,
    "rates_roundtrip": rates_roundtrip,
    "country_dim": country_dim,
    "country_list": country_list,
    "month_dim": month_dim,
    "expense_category": expense_category_query,
    "drop_null_key": drop_null_key,
    "trip_dates": _line_dates,
    "trip_duration": trip_duration,
    "pivot_expenses": lambda t: rollup.pivot_expenses(t.amounts),
    "trip_meta_first": lambda t: rollup.trip_meta(t.lines),
    "trip_rollup": trip_rollup,
    "allowance_left_join": allowance_left_join,
    "rate_median": lambda t: allowance.rate_median(t.rated),
    "rate_median_fill": rate_median_fill,
    "trip_allowance": trip_allowance,
    "category_index": category_index,
    "one_hot_wide": one_hot_wide,
    "feature_frame": feature_frame,
    "country_lookup": country_lookup,
    "global_rank": global_rank,
    "ordered_split": ordered_split,
    "guard_counts": guard_counts,
    "union_train_test": union_train_test,
    "history_tail": history_tail,
    "category_shares": category_shares,
    "minmax_fit": minmax_fit,
    "minmax_transform": minmax_transform,
    "minmax_inverse": minmax_inverse,
    "sequence_windows": sequence_windows,
    "eval_windows": eval_windows,
    "future_rows": future_rows_query,
    "future_window": future_window,
    "hybrid_average": hybrid_average,
    "error_metrics": error_metrics,
    "breakdown_long": breakdown_long,
    "forecast_series": forecast_series,
    "calendar_features": calendar_features,
    "trend_hinges": trend_hinges,
    "additive_fit": additive_fit,
    "additive_predict": additive_predict,
    "additive_closed_form": additive_closed_form,
    "sequence_closed_form": sequence_closed_form,
    "hybrid_closed_form": hybrid_closed_form,
    "evaluate_closed_form": evaluate_closed_form,
    "forecast_closed_form": forecast_closed_form,
    "fallback_closed_form": fallback_closed_form,
    "stream_closed_form": stream_closed_form,
    "bundle_closed_form": bundle_closed_form,
    "origins_closed_form": origins_closed_form,
    "evaluate_from_origins": evaluate_from_origins,
    "sequence_fit": sequence_fit,
    "sequence_predict": sequence_predict,
    "recurrent_predict": recurrent_predict,
    "hybrid_fit": hybrid_fit,
    "evaluate_hybrid": evaluate_hybrid,
    "forecast": forecast_query,
    "fallback_forecast": fallback_forecast,
    "model_roundtrip": model_roundtrip,
    "bundle_equals_fit": bundle_equals_fit,
    "stream_forecast": stream_forecast,
    "stream_equals_batch": stream_equals_batch,
    "stream_new_model": stream_new_model,
    "rollup_from_batches": rollup_from_batches,
    "trips_from_batches": trips_from_batches,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(Tables(spark, sf_dir))

    return {name: bind(query) for name, query in QUERIES.items()}
