"""Language, toxicity and quality: held-out accuracy and odd inputs."""

import random

import cases
import numpy as np
from pyspark.sql import functions as F
from tripledger.llm import common, language, quality, toxicity

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    rows = (
        language.op4_language_codes(spark, SF)
        .join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
        .where("held_out")
        .collect()
    )
    right = np.mean([r["lang"] == r["lang_pred"] for r in rows])
    assert len(rows) > 200 and right >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    model = language.fit(
        spark.createDataFrame(
            [(k, t, lang) for k, (t, lang) in enumerate(
                [("the house and the tree", "en"), ("das haus und der baum", "de"),
                 ("la maison et un arbre", "fr")] * 20)],
            "doc_id long, text string, lang string",
        )
    )
    found = {
        r["doc_id"]: r
        for r in language.identify(
            cases.table(spark, [(1, None), (2, ""), (3, "... 123 !"), (4, "the tree"),
                                (5, "der baum " * 3_000_000), (6, "é")]), model
        ).collect()
    }
    assert [found[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3
    assert found[4]["lang_pred"] == "en" and found[5]["lang_pred"] == "de"
    assert found[6]["lang_pred"] in ("en", "de", "fr")
    assert language.identify(cases.empty(spark), model).count() == 0
    none = language.fit(cases.table(spark).where("lang = 'none'"))
    assert {r["lang_pred"] for r in language.identify(cases.table(spark), none).collect()} == {"und"}
    one = language.fit(cases.table(spark, [(1, "abc"), (3, "def")]))
    assert language.identify(cases.table(spark, [(1, "abc")]), one).first()["lang_pred"] == "en"


def test_samples_are_bounded_whatever_the_ids(spark):
    """A third of all rows share one id, and some rows come very often."""
    rows = [(7, f"text number {k}", "en") for k in range(3000)] + [(k, f"other {k}", "en") for k in range(3000)]
    rows += [(9, "the same", "en")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, counts = common.balanced_sample(docs, "lang", "doc_id", "text", most=900)
    assert counts == {"en": 9000}
    found = [tuple(r) for r in sample.distinct().collect()]
    shared = sum(i == 7 for i, _, _ in found)
    assert 450 < len(found) < 750 and 220 < shared < 390
    few = common.few_of_each(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in few}[7] == common.TEXTS_PER_ID
    assert max(r["count"] for r in few) == common.TEXTS_PER_ID and len(few) == 3000


def test_codewords_are_apart():
    for n in (2, 3, 5, 6, 30):
        code = language.code_words(n)
        assert len({tuple(w) for w in code.tolist()}) == n
        assert all(len(set(bit)) == 2 for bit in code.T.tolist())


def test_gram_sums_equal_counts():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(len(language.SIZES) << language.BITS, 2)).astype(np.float32)
    texts = ["", "a", "Straße und Bäume", "x" * 50, "zwei\nZeilen"]
    total, count = language.gram_sums(texts, weights)
    for k, text in enumerate(texts):
        found = language.gram_counts([text])
        assert found.sum() == count[k]
        assert np.allclose(found @ weights, total[k], atol=1e-3)


def labelled(seed, n):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = cases.prose(rng, rng.randint(20, 200)).split(" ")
        if rng.random() < 0.3:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vermin", "scoundrel", "nitwit"])
            labels.append(1)
        else:
            labels.append(0)
        texts.append(" ".join(words))
    return texts, np.array(labels)


def test_toxic_words_are_learned_in_long_texts_and_misspelled():
    texts, labels = labelled(1, 600)
    model = toxicity.train(texts, labels, labels.mean())
    texts, labels = labelled(2, 200)
    right = (model.scores(texts) >= 0.5) == labels
    assert right.mean() >= 0.95
    bent = model.scores(["you scoundrell there", "a scoundreel of this kind", "ran sol tur nat ost"])
    assert (bent[:2] > bent[2]).all()


def test_toxicity_of_odd_inputs(spark):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 0)], "doc_id long, toxic int"
    )
    docs = cases.table(spark, [(1, "bad word here"), (2, None), (4, "plain"), (5, ""), (5, "")])
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(cases.empty(spark), toxicity.fit(docs, labels)).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, none).collect())
    assert toxicity.fit(cases.empty(spark), labels).bias < 0


def test_grades_are_ordered_and_recovered():
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(3000, 4))
    score = rows @ [2.0, -1.0, 0.5, 0.0] + rng.logistic(size=3000)
    grade = np.digitize(score, [-2, 0, 2.5])
    weights, cuts = quality.train(rows, grade, np.bincount(grade) / 3000, steps=400)
    assert (np.diff(cuts) > 0).all()
    assert np.allclose(cuts, [-2, 0, 2.5], atol=0.35)
    assert np.allclose(weights, [2, -1, 0.5, 0], atol=0.25)
    model = quality.OrdinalModel([0, 1, 2, 3], weights, cuts)
    chance = model.chances(rows)
    assert np.allclose(chance.sum(axis=1), 1) and (chance >= 0).all()


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.op10_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good = [r["selected"] for r in rows if r["quality"] == 1]
    bad = [r["selected"] for r in rows if r["quality"] == 0]
    assert len(rows) > 60 and np.mean(good) >= 0.97 and np.mean(bad) <= 0.4


def test_quality_of_odd_inputs(spark):
    ratings = spark.createDataFrame(
        [(k, k % 3) for k in range(30)] + [(1, 2), (None, 1), (7, None)],
        "doc_id long, quality int",
    )
    docs = cases.table(spark)
    model = quality.fit(docs, ratings)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    found = quality.rate(docs, model).collect()
    assert len(found) == docs.count()
    assert all(0 <= r["expected_grade"] <= 2 and 0 <= r["tail"] <= 1 for r in found)
    assert quality.rate(cases.empty(spark), model).count() == 0
    none = quality.fit(docs, ratings.limit(0))
    assert quality.rate(docs, none).where("tail = 1 AND expected_grade IS NULL").count() == len(found)
    kept = quality.select(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(found)
    same = quality.fit(docs, ratings.where("quality = 1"))
    assert quality.rate(docs, same).select("expected_grade").distinct().collect()[0][0] == 1
