import pytest

import __spark_entry__ as contract
from compare import differences

ORACLES = contract.oracle_sql()
QUERIES = contract.queries()


def test_every_expected_result_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) == []


def test_entry(spark, sf_dir):
    assert contract.entry(spark).count() == 1473


@pytest.mark.parametrize(
    "name, columns",
    [
        ("additive_predict", ["report_key", "ds", "y", "additive"]),
        ("sequence_fit", ["rmse", "mse"]),
        ("model_roundtrip", ["request_id", "total_fitted", "total_loaded"]),
        ("stream_forecast", None),
    ],
)
def test_model_queries(spark, sf_dir, name, columns):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and (columns is None or df.columns == columns)
    if name == "model_roundtrip":
        assert all(r.total_fitted == r.total_loaded for r in rows)
    if name == "stream_forecast":
        assert len(rows) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()


def test_scans_read_only_what_is_used(spark, sf_dir):
    plan = QUERIES["pivot_expenses"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    lineitem = next(part for part in plan.split("FileScan") if "l_orderkey" in part.split("]")[0])
    read = lineitem.split("ReadSchema:")[1].split(">")[0]
    assert "l_extendedprice" in read and "l_shipdate" not in read and "l_tax" not in read
