"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text is shared by all grades; ordered
thresholds cut its score into grades: P(grade <= k) = logistic(threshold_k -
score). A document gets its expected grade and the probability of reaching a
wanted grade, by which it is selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.common import (
    balanced_sample,
    few_of_each,
    hashed_grams,
    map_batches,
    read_table,
    remainder,
    texts_of,
)

SIZE = 3
BITS = 11
SHAPES = 8
FEATURES = (1 << BITS) + SHAPES
BLOCK = 1 << 20
#: Rated rows of each grade that the model is fitted on, about.
ROWS_PER_GRADE = 1500
STEPS = 200
RATE = 0.05
RIDGE = 1e-5
#: Documents with less probability of reaching the wanted grade are rejected.
KEEP = 0.5


def features(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole text and its shape, as a dense vector.

    Trigrams count by the square root of their share. The shape: shares of
    upper case, digits, white space, other ASCII signs and bytes beyond ASCII,
    the share of distinct words, and two logarithms of length.
    """
    data = np.frombuffer(text.encode(), np.uint8)
    count = np.zeros(1 << BITS)
    kinds = np.zeros(256)
    for at in range(0, len(data), BLOCK):
        grams = hashed_grams(data[at : at + BLOCK + SIZE - 1], SIZE, BITS)
        count += np.bincount(grams, minlength=1 << BITS)
        kinds += np.bincount(data[at : at + BLOCK], minlength=256)
    words = text.split()
    total = max(1, len(data))
    upper, digit, lower = kinds[65:91].sum(), kinds[48:58].sum(), kinds[97:123].sum()
    white = kinds[[9, 10, 11, 12, 13, 32]].sum()
    shape = [
        upper / total,
        digit / total,
        white / total,
        (kinds[:128].sum() - upper - digit - lower - white) / total,
        kinds[128:].sum() / total,
        len(set(words)) / max(1, len(words)),
        np.log1p(len(words)) / 10,
        np.log1p(len(data) / max(1, len(words))) / 4,
    ]
    return np.concatenate([np.sqrt(count / max(1.0, count.sum())), shape])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    grades: list[int]  # in rising order
    weights: np.ndarray
    thresholds: np.ndarray  # one fewer than grades, rising

    def chances(self, rows: np.ndarray) -> np.ndarray:
        """Probability of each grade, a row for each document."""
        score = rows @ self.weights
        upto = _logistic(self.thresholds[None, :] - score[:, None])
        ends = np.ones((len(rows), 1))
        return np.diff(np.concatenate([0 * ends, upto, ends], axis=1), axis=1)


def train(
    rows: np.ndarray, grade: np.ndarray, share: np.ndarray, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the penalised likelihood.

    ``grade`` counts from 0; ``share`` is each grade's share of all ratings, to
    which the sample is weighted. Thresholds are the first one and the sums of
    exponentials of gaps, so they stay in order.
    """
    grades = len(share)
    weight = (share / np.bincount(grade, minlength=grades))[grade]
    below = np.clip(np.cumsum(share)[:-1], 1e-6, 1 - 1e-6)
    start = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    held = np.concatenate([np.zeros(rows.shape[1]), start[:1], gaps])
    first, second = np.zeros_like(held), np.zeros_like(held)
    n = rows.shape[1]
    for step in range(1, steps + 1):
        cut = held[n] + np.concatenate([[0.0], np.cumsum(np.exp(held[n + 1 :]))])
        edges = np.concatenate([[-40.0], cut, [40.0]])
        score = rows @ held[:n]
        low, high = _logistic(edges[grade] - score), _logistic(edges[grade + 1] - score)
        chance = np.maximum(high - low, 1e-12)
        rise = weight * high * (1 - high) / chance
        fall = weight * low * (1 - low) / chance
        slope_cut = np.bincount(grade, -rise, grades)[:-1] + np.bincount(grade, fall, grades)[1:]
        later = np.cumsum(slope_cut[::-1])[::-1]
        slope = np.concatenate(
            [
                rows.T @ (rise - fall) + RIDGE * held[:n],
                later[:1],
                later[1:] * np.exp(held[n + 1 :]),
            ]
        )
        first += 0.1 * (slope - first)
        second += 0.01 * (slope**2 - second)
        rate = RATE / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        held -= rate * first / (np.sqrt(second) + 1e-9)
    return held[:n], held[n] + np.concatenate([[0.0], np.cumsum(np.exp(held[n + 1 :]))])


def fit(
    documents: DataFrame,
    ratings: DataFrame,
    grade: str = "quality",
    rows_per_grade: int = ROWS_PER_GRADE,
) -> OrdinalModel:
    """Fit on documents with a rating.

    A document that is rated more than once counts with its highest rating; null
    ratings are left out. About ``rows_per_grade`` ids of each grade, chosen by
    a hash of the id, are drawn, of each ``TEXTS_PER_ID`` texts at most; features are made where the texts are. Without
    ratings, or with one grade only, every document gets that grade.
    """
    known = (
        ratings.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(grade).cast("int").alias("grade"))
    )
    sample, counts = balanced_sample(known, "grade", "doc_id", most=rows_per_grade)

    def rows(batch: pa.RecordBatch):
        made = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("grade"), pa.array(made, pa.binary())],
            ["doc_id", "grade", "x"],
        )

    # The sample is bounded, so it may be broadcast to where the texts are.
    joined = texts_of(documents).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "grade")
    joined = few_of_each(joined)
    found = sorted(
        map_batches(joined, rows, "doc_id long, grade int, x binary").collect(),
        key=lambda r: (r["doc_id"], r["x"]),
    )
    grades = sorted({r["grade"] for r in found}) or sorted(counts)
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(FEATURES), np.zeros(0))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in found])
    y = np.searchsorted(grades, [r["grade"] for r in found])
    share = np.array([counts[g] for g in grades], float)
    return OrdinalModel(grades, *train(x, y, share / share.sum()))


def rate(documents: DataFrame, model: OrdinalModel, wanted: int | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``expected_grade`` and ``tail`` of every document.

    ``tail`` is the probability of at least the ``wanted`` grade, the highest by
    default. Null and empty texts are rated like any other. A model without
    grades gives a null grade and tail 1.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    wanted = wanted if wanted is not None else max(model.grades, default=0)

    @F.pandas_udf("expected double, tail double")
    def rated(texts):
        import pandas as pd

        model = shared.value
        if not model.grades:
            return pd.DataFrame({"expected": np.nan, "tail": np.ones(len(texts))})
        grades = np.array(model.grades)
        expected, tail = [], []
        # A few texts at a time keep the dense features small.
        for at in range(0, len(texts), 256):
            rows = np.stack([features(t) for t in texts.iloc[at : at + 256]])
            chance = model.chances(rows)
            expected.append(chance @ grades)
            tail.append(chance[:, grades >= wanted].sum(axis=1))
        return pd.DataFrame({"expected": np.concatenate(expected), "tail": np.concatenate(tail)})

    return (
        texts_of(documents)
        .withColumn("r", rated("text"))
        .select(
            "doc_id",
            "text",
            F.when(~F.isnan("r.expected"), F.col("r.expected")).alias("expected_grade"),
            F.col("r.tail").alias("tail"),
        )
    )


def select(documents: DataFrame, model: OrdinalModel, wanted: int | None = None) -> DataFrame:
    """The documents, all columns as they are, that reach the wanted grade likely enough."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    wanted = wanted if wanted is not None else max(model.grades, default=0)

    @F.pandas_udf("boolean")
    def kept(texts):
        import pandas as pd

        model = shared.value
        if not model.grades:
            return pd.Series(np.ones(len(texts), bool))
        out = []
        for at in range(0, len(texts), 256):
            chance = model.chances(np.stack([features(t) for t in texts.iloc[at : at + 256]]))
            out.append(chance[:, np.array(model.grades) >= wanted].sum(axis=1) >= KEEP)
        return pd.Series(np.concatenate(out))

    return documents.where(kept(F.coalesce(F.col("text"), F.lit(""))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents; every fourth rated id (by crc32) is held out of the fit."""
    documents = read_table(spark, sf_dir, "documents")
    learn = read_table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 3)
    return rate(documents, fit(documents, learn)).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 3).alias("held_out"),
        "expected_grade",
        F.col("tail").alias("tail_probability"),
        (F.col("tail") >= KEEP).alias("selected"),
    )
