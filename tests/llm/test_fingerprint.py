import hashlib
import random
from collections import Counter

import cases
import numpy as np
from pyspark.sql import functions as F
from tripledger.llm import fingerprint


def test_edits_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET", 5)
    made = cases.rows()
    rows = fingerprint.compare_with_edits(cases.table(spark, made).repartition(4)).collect()
    order = sorted(
        ((-(2**63) if i is None else i, t or "", i) for i, t in made),
        key=lambda r: (-r[0], r[1].encode()),
    )
    want = Counter()
    for k, (_, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[(i, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    text_of = {i: t or "" for i, t in made if i is not None and i != made[1][0]}
    prints = {r["doc_id"]: r["fingerprint"] for r in rows if r["doc_id"] in text_of}
    for i, a in text_of.items():
        for j, b in text_of.items():
            same = Counter(a.split("\n") if a else []) == Counter(b.split("\n") if b else [])
            assert (prints[i] == prints[j]) == same


def test_edits_are_nearer_than_other_documents(spark):
    rows = fingerprint.op1_fingerprints(spark, "/root/testdata/sf0.01").where("n_chars > 200")
    rows = rows.collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.97
    assert abs(np.median([r["near_edited"] for r in rows]) - 0.5) < 0.15


def test_sums_are_homomorphic(spark):
    rng = random.Random(3)
    parts = [cases.prose(rng, rng.randint(1, 30)).replace("\n", " ") for _ in range(6)]
    made = [(1, "\n".join(parts)), (2, "\n".join(reversed(parts))), (3, "\n".join(parts[:4])),
            (4, "\n".join(parts[4:])), (5, ""), (6, None)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    prints = fingerprint.fingerprints(frame, "text", "doc_id")
    found = {r["doc_id"]: r for r in prints.collect()}
    assert found[1]["fingerprint"] == found[2]["fingerprint"] != found[3]["fingerprint"]
    assert set(found[5]["lanes"]) == set(found[6]["lanes"]) == {0}
    one = prints.where("doc_id = 3").select(F.col("lanes").alias("a"))
    other = prints.where("doc_id = 4").select(F.col("lanes").alias("b"))
    added = one.join(other).select(fingerprint.combine("a", "b").alias("s"), "b")
    back = added.select("s", fingerprint.combine("s", "b", -1).alias("d")).first()
    assert back["s"] == found[1]["lanes"] and back["d"] == found[3]["lanes"]


def test_no_python_in_the_plan(spark):
    rows = fingerprint.compare_with_edits(cases.table(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_one_document_and_none(spark):
    one = fingerprint.compare_with_edits(cases.table(spark, [(1, "abcd efgh")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest()
    assert one["near_next"] == 1.0
    assert fingerprint.compare_with_edits(cases.empty(spark)).count() == 0


def test_likeness_of_very_repetitive_texts(spark):
    made = [(2, "ab " * 40_000), (1, "ab " * 20_000), (0, "cd " * 100_000)]
    rows = {r["doc_id"]: r for r in fingerprint.compare_with_edits(cases.table(spark, made)).collect()}
    assert rows[2]["near_next"] > 0.99 and rows[2]["near_edited"] > 0.99
    assert rows[1]["near_next"] < 0.7
