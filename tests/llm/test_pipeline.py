import __spark_entry__ as registry
import cases
import corpus_pipeline
import pytest
from compare import differences
from pyspark.sql import functions as F
from tripledger.llm import queries, secrets

SF = "/root/testdata/sf0.001"


def test_registered():
    names = registry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(queries.oracles()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_oracles(spark, name):
    assert differences(queries.registered()[name](spark, SF), queries.oracles()[name], SF) == []


def test_stages_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = docs if name == "quality" else docs.select(*before.columns)
        results[name] = docs = stage(spark, docs, SF).cache()
        if name != "packing":
            assert docs.columns == before.columns
    good = labels.where("quality = 1").count()
    assert results["quality"].join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * good
    texts = results["near_duplicates"].select("text")
    assert texts.distinct().count() == texts.count()
    assert results["repeats"].count() == results["secrets"].count()
    redacted = results["secrets"]
    assert secrets.scan(redacted, f"{spark.conf.get('spark.checkpoint.dir')}/again").where(
        F.size("found") > 0
    ).count() == 0
    assert results["packing"].select("doc_id").distinct().count() == redacted.count()
    for frame in results.values():
        frame.unpersist()


def test_stages_on_odd_documents(spark):
    docs = cases.table(spark)
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            assert out.count() >= total
            continue
        assert out.columns == list(corpus_pipeline.COLUMNS)
        assert out.count() <= total and (name not in ("repeats", "secrets") or out.count() == total)
        assert stage(spark, cases.empty(spark), SF).count() == 0


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    ]
    assert rows.count() > 0
