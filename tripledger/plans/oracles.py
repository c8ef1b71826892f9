"""DuckDB SQL with the expected result of each query, on the whole tables."""

from __future__ import annotations

import math
import re

# Fixed values, written out here so that they do not follow the code they check.
YEARLY = ("yearly", 365.25, 10)
WEEKLY = ("weekly", 7.0, 3)
COST_ITEMS = {
    "Air Ticket": "y_air_ticket",
    "Accommodation": "y_hotel",
    "Daily Allowance": "y_daily_allowance",
    "Others": "y_others",
}
# Codes of the built-in rate table in order, and the rate of each.
BUILTIN_CODES = (
    "AE AR AT AU BA BD BE BG BH BR BY CA CH CL CN CO CR CZ DE DK DO DZ EC EG ES FI FR GB GR "
    "GT HR HU ID IE IN IT JP KE KR KZ LK LT LU LV MA MC MM MX MY NG NL NO NZ OM PA PE PH PK "
    "PL PT PY RO RS RU SA SE SG SI SK TH TN TR TW US UY VN ZA "
).split()
BUILTIN_RATES = [
    120, 75, 95, 115, 65, 40, 95, 70, 120, 70, 60, 105, 125, 80, 80, 70, 75, 80, 95, 110, 85,
    60, 65, 55, 95, 110, 95, 110, 85, 70, 75, 75, 60, 100, 50, 95, 120, 60, 110, 70, 50, 75, 95,
    75, 65, 120, 50, 80, 70, 60, 95, 115, 115, 120, 75, 70, 60, 50, 85, 85, 70, 70, 65, 85, 120,
    90, 120, 80, 80, 70, 60, 75, 110, 100, 80, 60, 70,
]
_CODES = sorted(f"NATION_{i}" for i in range(24))

STEPS: dict[str, str] = {
    "lines": """
        SELECT 'EUR' AS currency_key, 'Euro' AS currency_name, dn.n_name AS dest_country,
               CASE WHEN hn.n_name = dn.n_name THEN 'DOMESTIC' ELSE 'FOREIGN' END AS dom_intl_flag,
               strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INTEGER), '%Y%m%d')
                 AS end_date_raw,
               CASE l_returnflag || l_linestatus
                 WHEN 'RF' THEN 'HOTEL' WHEN 'RO' THEN 'AIR TICKET' WHEN 'AF' THEN 'DAILY ALLOWANCE'
                 WHEN 'AO' THEN 'TAXI' WHEN 'NF' THEN 'FUEL' END AS expense_type,
               hn.n_name AS home_country, l_orderkey AS report_key,
               strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS start_date_raw,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_eur,
               (l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord
        FROM lineitem
        LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation hn ON c_nationkey = hn.n_nationkey
        LEFT JOIN supplier ON l_suppkey = s_suppkey
        LEFT JOIN nation dn ON s_nationkey = dn.n_nationkey""",
    "rates": """
        SELECT n_name AS country, CAST(40 + 5 * n_nationkey AS DOUBLE) AS daily_allowance
        FROM nation WHERE n_nationkey < 23""",
    "countries": """
        SELECT n_name AS code, r_name || ' / ' || n_name AS name,
               CAST(ROW_NUMBER() OVER (ORDER BY n_name) - 1 AS INTEGER) AS idx
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_24'""",
    "homes": """
        SELECT c_custkey, n_name AS home_country
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "requests": """
        SELECT c_custkey AS request_id, hn.n_name AS home_country, dn.n_name AS dest_country,
               CAST(c_custkey % 21 AS INTEGER) AS num_days,
               CAST(c_custkey % 12 + 1 AS INTEGER) AS month,
               CAST(CASE WHEN c_custkey % 3 <> 0 THEN 1998 + c_custkey % 2 END AS INTEGER) AS year
        FROM customer
        JOIN nation hn ON c_nationkey = hn.n_nationkey
        JOIN nation dn ON (c_custkey * 7 + c_nationkey) % 25 = dn.n_nationkey""",
    "rolled": """
        SELECT report_key,
               arg_min(start_date_raw, ord) FILTER (WHERE start_date_raw IS NOT NULL) AS start_date_raw,
               arg_min(end_date_raw, ord) FILTER (WHERE end_date_raw IS NOT NULL) AS end_date_raw,
               arg_min(home_country, ord) FILTER (WHERE home_country IS NOT NULL) AS home_country,
               arg_min(dest_country, ord) FILTER (WHERE dest_country IS NOT NULL) AS dest_country,
               CAST(COALESCE(SUM(amount_eur) FILTER (WHERE expense_type = 'HOTEL'), 0) AS DOUBLE)
                 AS y_hotel,
               CAST(COALESCE(SUM(amount_eur) FILTER (WHERE expense_type = 'AIR TICKET'), 0) AS DOUBLE)
                 AS y_air_ticket,
               CAST(COALESCE(SUM(amount_eur) FILTER (WHERE expense_type = 'DAILY ALLOWANCE'), 0)
                 AS DOUBLE) AS spent_allowance,
               CAST(COALESCE(SUM(amount_eur) FILTER (WHERE expense_type IS NULL OR
                 expense_type NOT IN ('HOTEL', 'AIR TICKET', 'DAILY ALLOWANCE')), 0) AS DOUBLE)
                 AS y_others
        FROM lines WHERE report_key IS NOT NULL GROUP BY report_key""",
    "dated": """
        SELECT *, CAST(CASE WHEN date_diff('day', ds, ended) < 1 THEN 1
                            ELSE date_diff('day', ds, ended) END AS INTEGER) AS duration
        FROM (SELECT *, CAST(strptime(start_date_raw, '%Y%m%d') AS DATE) AS ds,
                     CAST(strptime(end_date_raw, '%Y%m%d') AS DATE) AS ended FROM rolled)""",
    "rated": """
        SELECT dated.*, daily_allowance FROM dated LEFT JOIN rates ON home_country = country""",
    "trips": """
        SELECT report_key, ds, home_country, dest_country, duration, y_hotel, y_air_ticket, y_others,
               y_daily_allowance, y_hotel + y_air_ticket + y_daily_allowance + y_others AS y
        FROM (SELECT *, COALESCE(daily_allowance, (SELECT median(daily_allowance) FROM rated))
                        * duration AS y_daily_allowance FROM rated)""",
    "ranked": """
        SELECT trips.*, h.idx AS home_idx, d.idx AS dest_idx,
               ROW_NUMBER() OVER (ORDER BY report_key) - 1 AS rn, COUNT(*) OVER () AS n
        FROM trips LEFT JOIN countries h ON home_country = h.code
        LEFT JOIN countries d ON dest_country = d.code""",
    "split": """
        SELECT *, rn < n - CAST(CEIL(CAST(0.2 AS DOUBLE) * n) AS BIGINT) AS is_train FROM ranked""",
    "train": "SELECT * FROM split WHERE is_train",
    "test": "SELECT * FROM split WHERE NOT is_train",
    "bounds": """
        SELECT MIN(y) AS y0, MAX(y) - MIN(y) AS yr, CAST(MIN(duration) AS DOUBLE) AS d0,
               CAST(MAX(duration) - MIN(duration) AS DOUBLE) AS dr FROM train""",
    "days": "SELECT DISTINCT ds, ds - DATE '1970-01-01' AS day FROM train",
    "aligned": """
        SELECT report_key, y, y_hotel + y_air_ticket AS additive,
               y_others + y_daily_allowance AS sequence,
               (y_hotel + y_air_ticket + (y_others + y_daily_allowance)) / 2 AS hybrid FROM test""",
    "shares": "SELECT "
    + ", ".join(
        f"SUM({column}) / SUM(y) AS {item.lower().replace(' ', '_')}"
        for item, column in COST_ITEMS.items()
    )
    + " FROM train",
    "line_fit": """
        SELECT y0, t0, d0, (yt * dd - yd * td) / (tt * dd - td * td) AS bt,
               (yd * tt - yt * td) / (tt * dd - td * td) AS bd
        FROM (SELECT AVG(y) AS y0, AVG(ds - DATE '1970-01-01') AS t0, AVG(duration) AS d0,
                     covar_pop(y, ds - DATE '1970-01-01') AS yt, covar_pop(y, duration) AS yd,
                     var_pop(ds - DATE '1970-01-01') AS tt, var_pop(duration) AS dd,
                     covar_pop(ds - DATE '1970-01-01', duration) AS td
              FROM train)""",
    "cuts": """
        SELECT origin, lead(origin) OVER (ORDER BY origin) AS following
        FROM (SELECT (SELECT COUNT(*) FROM train) * k // 3 AS origin FROM range(1, 4) r(k))""",
    "origin_fits": """
        SELECT *, (yt * dd - yd * td) / (tt * dd - td * td) AS bt,
               (yd * tt - yt * td) / (tt * dd - td * td) AS bd
        FROM (SELECT origin, following, AVG(y) AS y0, AVG(ds - DATE '1970-01-01') AS t0,
                     AVG(duration) AS d0, covar_pop(y, ds - DATE '1970-01-01') AS yt,
                     covar_pop(y, duration) AS yd, var_pop(ds - DATE '1970-01-01') AS tt,
                     var_pop(duration) AS dd, covar_pop(ds - DATE '1970-01-01', duration) AS td
              FROM cuts JOIN split ON rn < origin GROUP BY origin, following)""",
    "lagged": """
        SELECT *, lag(y) OVER (ORDER BY rn) AS py, lag(duration) OVER (ORDER BY rn) AS pd
        FROM split""",
    "step_fit": """
        SELECT z0, p0, q0, (zp * qq - zq * pq) / (pp * qq - pq * pq) AS bp,
               (zq * pp - zp * pq) / (pp * qq - pq * pq) AS bq
        FROM (SELECT AVG(y) AS z0, AVG(py) AS p0, AVG(pd) AS q0, covar_pop(y, py) AS zp,
                     covar_pop(y, pd) AS zq, var_pop(py) AS pp, var_pop(pd) AS qq,
                     covar_pop(py, pd) AS pq
              FROM lagged WHERE is_train AND rn >= 1)""",
    "one_step": """
        SELECT report_key, y, y0 + (ds - DATE '1970-01-01' - t0) * bt + (duration - d0) * bd AS additive,
               z0 + (py - p0) * bp + (pd - q0) * bq AS sequence
        FROM lagged CROSS JOIN line_fit CROSS JOIN step_fit WHERE NOT is_train""",
    "asked": """
        SELECT request_id,
               y0 + (make_date(COALESCE(year, 2025), month, 1) - DATE '1970-01-01' - t0) * bt
                 + (num_days - d0) * bd AS additive,
               z0 + (0 - p0) * bp + (num_days - q0) * bq AS sequence
        FROM requests CROSS JOIN line_fit CROSS JOIN step_fit""",
    "steps": """
        SELECT rn, is_train, y, CAST(duration AS DOUBLE) AS duration,
               COALESCE(home_idx, -1) * 100 + COALESCE(dest_idx, -1) AS positions FROM split""",
    "framed": """
        SELECT rn, is_train, CAST(COUNT(*) OVER w AS INTEGER) AS n_steps,
               first_value(y) OVER w AS first_y, last_value(y) OVER w AS last_y,
               list(y) OVER w AS ys, list(duration) OVER w AS ds, list(positions) OVER w AS ps
        FROM steps WINDOW w AS (ORDER BY rn ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
}


def _window_summary(flag: str) -> str:
    return f"""
        SELECT rn, n_steps, ROUND(first_y, 2) AS first_y, ROUND(last_y, 2) AS last_y,
               ROUND(list_sum(ys), 2) AS sum_y, ROUND(list_sum(ds), 2) AS sum_duration,
               CAST(list_sum(ps) AS DOUBLE) AS sum_positions
        FROM framed WHERE n_steps = 60 AND {flag}"""


def _season_columns() -> str:
    out = []
    for name, period, orders in (YEARLY, WEEKLY):
        for order in range(1, orders + 1):
            angle = f"CAST({2.0 * math.pi * order / period!r} AS DOUBLE) * day"
            for f in ("sin", "cos"):
                value = f"ROUND({f}({angle}), 6)"
                out.append(f"CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END AS {name}_{f}_{order}")
    return ", ".join(out)


def _one_hot(source: str, extra: str = "") -> str:
    flags = ", ".join(
        f"CASE WHEN {side}_country = '{code}' THEN 1 ELSE 0 END AS \"{side}_{code}\""
        for side in ("home", "dest")
        for code in _CODES
    )
    return f"SELECT report_key, {extra}{flags} FROM {source}"


def _min_max() -> str:
    parts = [
        "SELECT 'y' AS feature, MIN(y) AS min, MAX(y) AS max FROM train",
        "SELECT 'duration', CAST(MIN(duration) AS DOUBLE), CAST(MAX(duration) AS DOUBLE) FROM train",
    ]
    for side in ("home", "dest"):
        parts.append(
            f"SELECT '{side}_' || code, CAST(MIN(hit) AS DOUBLE), CAST(MAX(hit) AS DOUBLE) FROM "
            f"(SELECT code, CASE WHEN {side}_idx = idx THEN 1 ELSE 0 END AS hit "
            f"FROM countries CROSS JOIN (SELECT {side}_idx FROM train)) GROUP BY code"
        )
    return " UNION ALL ".join(parts)


def _closed_forecast(sequence: str, total: str) -> str:
    parts = ", ".join(
        f"ROUND({total} * {c}, 0) AS {c}" for c in (i.lower().replace(" ", "_") for i in COST_ITEMS)
    )
    return f"""
        SELECT request_id, ROUND({total}, 0) AS total, ROUND(additive, 0) AS additive,
               ROUND({sequence}, 0) AS sequence, {parts}
        FROM asked CROSS JOIN shares"""


_HINGES = ", ".join(
    f"ROUND(greatest(0.0, (day - p.at[{j}]) / p.span), 6) AS hinge_{j}" for j in range(1, 26)
)

FINAL: dict[str, str] = {
    "trip_totals": "SELECT * FROM trips",
    "scan_expense_lines": """
        SELECT currency_key, currency_name, dest_country, dom_intl_flag, end_date_raw, expense_type,
               home_country, report_key, start_date_raw, CAST(amount_eur AS DOUBLE) AS amount_eur
        FROM lines""",
    "scan_rates": """
        SELECT c_custkey, home_country, daily_allowance
        FROM homes LEFT JOIN rates ON home_country = country""",
    "builtin_rates": f"""
        SELECT c_custkey, {BUILTIN_CODES!r}[c_custkey % 77 + 1] AS country,
               CAST({BUILTIN_RATES!r}[c_custkey % 77 + 1] AS DOUBLE) AS daily_allowance
        FROM customer""",
    "rates_roundtrip": """
        SELECT country, daily_allowance, COUNT(c_custkey) AS n_customers
        FROM rates LEFT JOIN homes ON home_country = country GROUP BY country, daily_allowance""",
    "country_dim": """
        SELECT code, name, COUNT(c_custkey) AS n_customers
        FROM countries LEFT JOIN homes ON home_country = code GROUP BY code, name""",
    "country_list": """
        SELECT idx AS position, code, COUNT(s_suppkey) AS n_suppliers
        FROM countries JOIN nation ON n_name = code LEFT JOIN supplier ON s_nationkey = n_nationkey
        GROUP BY idx, code""",
    "month_dim": """
        SELECT CAST(m AS INTEGER) AS month, monthname(make_date(2000, CAST(m AS INTEGER), 1)) AS name,
               COUNT(o_orderkey) AS n_trips
        FROM range(1, 13) r(m) LEFT JOIN orders ON month(o_orderdate) = m GROUP BY m""",
    "expense_category": """
        SELECT report_key, expense_type, CAST(amount_eur AS DOUBLE) AS amount_eur,
               CASE WHEN expense_type IN ('HOTEL', 'AIR TICKET', 'DAILY ALLOWANCE')
                    THEN expense_type ELSE 'Others' END AS category
        FROM lines""",
    "drop_null_key": """
        SELECT report_key, CAST(amount_eur AS DOUBLE) AS amount_eur
        FROM lines WHERE report_key % 10 <> 0""",
    "trip_dates": """
        SELECT report_key, CAST(strptime(start_date_raw, '%Y%m%d') AS DATE) AS start_date,
               CAST(strptime(end_date_raw, '%Y%m%d') AS DATE) AS end_date
        FROM lines""",
    "trip_duration": """
        SELECT report_key, CAST(CASE WHEN d < 1 THEN 1 ELSE d END AS INTEGER) AS duration,
               CAST(CASE WHEN -d < 1 THEN 1 ELSE -d END AS INTEGER) AS reversed_duration
        FROM (SELECT report_key,
                     date_diff('day', CAST(strptime(start_date_raw, '%Y%m%d') AS DATE),
                               CAST(strptime(end_date_raw, '%Y%m%d') AS DATE)) AS d FROM lines)""",
    "pivot_expenses": """
        SELECT report_key, y_hotel, y_air_ticket, spent_allowance, y_others FROM rolled""",
    "trip_meta_first": """
        SELECT report_key, start_date_raw, end_date_raw, home_country, dest_country FROM rolled""",
    "trip_rollup": "SELECT * FROM rolled",
    "allowance_left_join": "SELECT report_key, home_country, daily_allowance FROM rated",
    "rate_median": "SELECT median(daily_allowance) AS median_allowance FROM rated",
    "rate_median_fill": """
        SELECT report_key, home_country, COALESCE(daily_allowance,
               (SELECT median(daily_allowance) FROM rated)) AS daily_allowance FROM rated""",
    "trip_allowance": "SELECT report_key, duration, y_daily_allowance FROM trips",
    "category_index": """
        SELECT report_key, h.idx AS home_idx, d.idx AS dest_idx
        FROM rolled LEFT JOIN countries h ON home_country = h.code
        LEFT JOIN countries d ON dest_country = d.code""",
    "one_hot_wide": _one_hot("rolled"),
    "feature_frame": _one_hot("trips", "y, duration, "),
    "country_lookup": """
        SELECT report_key, dest_country, name AS dest_name
        FROM rolled LEFT JOIN countries ON dest_country = code""",
    "global_rank": "SELECT rn, report_key FROM ranked",
    "ordered_split": "SELECT report_key, rn, is_train FROM split",
    "guard_counts": """
        SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE is_train) AS n_train,
               COUNT(*) FILTER (WHERE NOT is_train) AS n_test,
               COUNT(*) FILTER (WHERE is_train AND rn >= 60) AS n_sequences,
               COUNT(*) FILTER (WHERE is_train AND rn >= 60) > 0 AS fits_sequence
        FROM split""",
    "union_train_test": "SELECT report_key, y, duration, home_idx, dest_idx, is_train FROM split",
    "scan_rejects": """
        SELECT COUNT(*) FILTER (WHERE report_key % 50 > 1) AS n_kept,
               ROUND(CAST(SUM(amount_eur) FILTER (WHERE report_key % 50 > 1) AS DOUBLE), 0)
                 AS amount_eur,
               COUNT(*) FILTER (WHERE report_key % 50 <= 1) AS n_rejected
        FROM lines""",
    "scan_requests": "SELECT home_country, dest_country, num_days, month, year FROM requests",
    "additive_closed_form": """
        SELECT report_key,
               ROUND(y0 + ((ds - DATE '1970-01-01') - t0) * (yt * dd - yd * td) / (tt * dd - td * td)
                        + (duration - d0) * (yd * tt - yt * td) / (tt * dd - td * td), 0) AS additive
        FROM test, (
          SELECT AVG(y) AS y0, AVG(ds - DATE '1970-01-01') AS t0, AVG(duration) AS d0,
                 covar_pop(y, ds - DATE '1970-01-01') AS yt, covar_pop(y, duration) AS yd,
                 var_pop(ds - DATE '1970-01-01') AS tt, var_pop(duration) AS dd,
                 covar_pop(ds - DATE '1970-01-01', duration) AS td
          FROM train) m""",
    "sequence_closed_form": """
        SELECT report_key, ROUND(sequence, 0) AS sequence FROM one_step""",
    "hybrid_closed_form": """
        SELECT report_key, ROUND(additive, 0) AS additive, ROUND(sequence, 0) AS sequence,
               ROUND((additive + sequence) / 2, 0) AS predicted FROM one_step""",
    "evaluate_closed_form": """
        SELECT ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse,
               ROUND(AVG((y - p) * (y - p)) / 1000, 1) AS mse_thousands
        FROM (SELECT y, (additive + sequence) / 2 AS p FROM one_step)""",
    "origins_closed_form": """
        SELECT f.origin, COUNT(*) AS trips, ROUND(SQRT(AVG((y - p) * (y - p))), 2) AS rmse,
               ROUND(AVG(y - p), 2) AS bias
        FROM (SELECT origin, y, y0 + (ds - DATE '1970-01-01' - t0) * bt + (duration - d0) * bd AS p
              FROM origin_fits f JOIN split s
                ON s.rn >= f.origin AND s.rn < COALESCE(f.following, s.n)) f
        GROUP BY f.origin""",
    "forecast_closed_form": _closed_forecast("sequence", "(additive + sequence) / 2"),
    "fallback_closed_form": _closed_forecast("CAST(0 AS DOUBLE)", "additive"),
    "stream_closed_form": _closed_forecast("sequence", "(additive + sequence) / 2"),
    "bundle_closed_form": _closed_forecast("sequence", "(additive + sequence) / 2"),
    "bundle_equals_fit": "SELECT request_id, TRUE AS same FROM requests",
    "stream_equals_batch": "SELECT request_id, TRUE AS same FROM requests",
    "stream_new_model": f"""
        SELECT *, CAST(1 AS INTEGER) AS model FROM (
          {_closed_forecast("sequence", "(additive + sequence) / 2")}) WHERE request_id % 2 = 0
        UNION ALL BY NAME
        SELECT *, CAST(2 AS INTEGER) AS model FROM (
          {_closed_forecast("CAST(0 AS DOUBLE)", "additive")}) WHERE request_id % 2 = 1""",
    "rollup_from_batches": "SELECT * FROM rolled",
    "trips_from_batches": "SELECT * FROM trips",
    "history_tail": "SELECT rn, report_key, y, duration FROM train ORDER BY rn DESC LIMIT 60",
    "category_shares": "SELECT "
    + ", ".join(
        f"ROUND({c}, 9) AS {c}" for c in (i.lower().replace(" ", "_") for i in COST_ITEMS)
    )
    + " FROM shares",
    "minmax_fit": _min_max(),
    "minmax_transform": """
        SELECT report_key, ROUND((y - y0) / yr, 9) AS y_scaled,
               ROUND((duration - d0) / dr, 9) AS duration_scaled,
               CAST(home_idx IS NOT NULL AS DOUBLE) AS home_scaled,
               CAST(dest_idx IS NOT NULL AS DOUBLE) AS dest_scaled
        FROM ranked CROSS JOIN bounds""",
    "minmax_inverse": """
        SELECT report_key, ROUND((y - y0) / yr * yr + y0, 2) AS y_restored
        FROM ranked CROSS JOIN bounds""",
    "sequence_windows": _window_summary("is_train"),
    "eval_windows": _window_summary("NOT is_train"),
    "future_rows": """
        SELECT request_id, make_date(COALESCE(year, 2025), month, 1) AS ds, num_days AS duration,
               h.idx AS home_idx, d.idx AS dest_idx
        FROM requests LEFT JOIN countries h ON home_country = h.code
        LEFT JOIN countries d ON dest_country = d.code""",
    "future_window": """
        SELECT request_id, CAST(k + 1 AS INTEGER) AS n_steps, ROUND(first_y, 6) AS first_y,
               ROUND((0 - y0) / yr, 6) AS last_y, ROUND(sum_y + (0 - y0) / yr, 6) AS sum_y,
               ROUND(sum_duration + (num_days - d0) / dr, 6) AS sum_duration,
               CAST(sum_positions + COALESCE(h.idx, -1) * 100 + COALESCE(d.idx, -1) AS DOUBLE)
                 AS sum_positions
        FROM requests LEFT JOIN countries h ON home_country = h.code
        LEFT JOIN countries d ON dest_country = d.code
        CROSS JOIN bounds
        CROSS JOIN (
            SELECT COUNT(*) AS k, arg_min((y - y0) / yr, rn) AS first_y,
                   SUM((y - y0) / yr) AS sum_y, SUM((duration - d0) / dr) AS sum_duration,
                   SUM(COALESCE(home_idx, -1) * 100 + COALESCE(dest_idx, -1)) AS sum_positions
            FROM (SELECT * FROM train ORDER BY rn DESC LIMIT 59) CROSS JOIN bounds)""",
    "hybrid_average": "SELECT report_key, additive, sequence, ROUND(hybrid, 3) AS hybrid FROM aligned",
    "error_metrics": """
        SELECT ROUND(SQRT(AVG((y - hybrid) * (y - hybrid))), 4) AS rmse,
               ROUND(AVG((y - hybrid) * (y - hybrid)) / 1000, 1) AS mse_thousands FROM aligned""",
    "breakdown_long": " UNION ALL ".join(
        f"SELECT report_key, '{item}' AS item, ROUND(y * {item.lower().replace(' ', '_')}, 2) AS cost "
        "FROM test CROSS JOIN shares"
        for item in COST_ITEMS
    ),
    "forecast_series": """
        SELECT report_key, 'additive' AS series, additive AS value FROM aligned
        UNION ALL SELECT report_key, 'sequence', sequence FROM aligned
        UNION ALL SELECT report_key, 'total', ROUND(hybrid, 3) FROM aligned""",
    "calendar_features": f"SELECT ds, {_season_columns()} FROM days",
    "trend_hinges": f"""
        SELECT ds, ROUND((day - p.first_day) / p.span, 6) AS trend, {_HINGES}
        FROM days CROSS JOIN (
            SELECT MIN(ds - DATE '1970-01-01') AS first_day,
                   CAST(MAX(ds) - MIN(ds) AS DOUBLE) AS span,
                   quantile_cont(ds - DATE '1970-01-01',
                     {[0.8 * j / 25 for j in range(1, 26)]!r}) AS at
            FROM train) p""",
}


def _with_steps(final: str) -> str:
    """The query with every step it needs, in order."""
    needed: set[str] = set()
    waiting = [final]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        for name in words & STEPS.keys() - needed:
            needed.add(name)
            waiting.append(STEPS[name])
    steps = ", ".join(f"{name} AS ({sql})" for name, sql in STEPS.items() if name in needed)
    return f"WITH {steps} {final}" if steps else final


def oracles() -> dict[str, str]:
    return {name: _with_steps(sql) for name, sql in FINAL.items()}
