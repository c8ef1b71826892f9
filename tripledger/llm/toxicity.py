"""Toxicity from subword bags: averaged n-gram embeddings and a linear softmax.

A text is a sequence of lower-case words; its features are the hashed byte
n-grams inside the word boundaries, so an unseen misspelling shares most
vectors with the word it bends. The embeddings of a short window of words are
averaged and fed to a linear softmax; a text's margin is the soft maximum of its
windows, so a few words count as much in a long text as in a short one.
Embeddings and softmax are trained jointly, in numpy, by Adam.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
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
    pieces_of,
    read_table,
    remainder,
    texts_of,
)

SIZES = (3, 4)
BITS = 15
DIMENSIONS = 12
WINDOW = 3  # words
#: Labelled rows of each class that the model is fitted on, about.
ROWS_PER_CLASS = 1500
STEPS = 100
DECAY = 0.03
#: Windows of fewer n-grams are averaged as if they had this many.
LEAST = 40
PIECE = 1 << 20
TOP = 0.5  # temperature of the soft maximum over windows
WORD = re.compile(r"[^\W_]+")


def _words(text: str) -> bytes:
    return " ".join(WORD.findall(text.lower())).encode()


def windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of the texts, block by block.

    Each block: the distinct hashed n-grams of each window, one window after the
    other; their number in each window; the text of each window. A text without a word
    has one window without n-grams. A long text comes in several blocks.
    """
    for a, b in pieces_of(texts, PIECE, len):
        each = [_words(t) for t in texts[a:b]]
        size = np.fromiter(map(len, each), np.int64, len(each))
        data = np.frombuffer(b" " + b"  ".join(each) + b" ", np.uint8)
        first = np.cumsum(size + 2) - size - 1  # of each text's first byte
        gap = data == 32
        word = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
        owner = np.searchsorted(first, word, side="right") - 1
        # Every WINDOW-th word of a text opens a window.
        nth = np.arange(len(word)) - np.searchsorted(word, first)[owner]
        opens = nth % WINDOW == 0
        starts, owners = word[opens], owner[opens]
        blank = np.flatnonzero(size == 0)
        kept, places = [], []
        for k, width in enumerate(SIZES):
            # Inside a word, with at most the spaces on either side of it.
            inner = np.ones(max(0, len(data) - width + 1), bool)
            for shift in range(1, width - 1):
                inner &= ~gap[shift : shift + len(inner)]
            at = np.flatnonzero(inner)
            kept.append(hashed_grams(data, width, BITS)[at] + np.uint32(k << BITS))
            # One that begins on the space before a word belongs to that word.
            places.append(np.searchsorted(starts, at + 1, side="right") - 1)
        # Each n-gram once in a window, so that a repeated word has no more say.
        pairs = np.sort((np.concatenate(places) << 32) | np.concatenate(kept).astype(np.int64))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        pairs = pairs[pairs >= 0]
        count = np.bincount(pairs >> 32, minlength=len(starts))
        yield (
            pairs & 0xFFFF,
            np.concatenate([count, np.zeros(len(blank), np.int64)]),
            np.concatenate([owners, blank]) + a,
        )


def _window_sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    held = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    end = np.cumsum(count)
    return held[end] - held[end - count]


@dataclass
class ToxicityModel:
    slope: np.ndarray  # of each feature: its embedding times the softmax weights' difference
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1; a text without words gets the base rate's."""
        margin, owner = [], []
        for grams, count, text in windows(texts):
            margin.append(_window_sums(self.slope[grams], count) / np.maximum(count, LEAST))
            owner.append(text)
        return _sigmoid(
            self.bias + _soft_top(np.concatenate(margin), np.concatenate(owner), len(texts))[0]
        )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _soft_top(
    margin: np.ndarray, owner: np.ndarray, n: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of each text's window margins, and the weights."""
    most = np.full(n, -np.inf)
    np.maximum.at(most, owner, margin)
    weight = np.exp((margin - most[owner]) / TOP)
    weight /= np.bincount(owner, weight, n)[owner]
    return np.bincount(owner, weight * margin, n), weight


def train(texts: list[str], labels: np.ndarray, prior: float, steps: int = STEPS) -> ToxicityModel:
    """Joint training of embeddings and softmax on whole texts.

    ``prior``: share of label 1 among all labelled rows; the classes of the
    sample are weighted to it, so that 0.5 stays the natural threshold.
    """
    rng = np.random.default_rng(0)
    # Two bytes for a feature keep the sample small.
    blocks = [(grams.astype(np.uint16), count, owner) for grams, count, owner in windows(texts)]
    owner = np.concatenate([o for _, _, o in blocks])
    features = len(SIZES) << BITS
    embedding = rng.normal(0, 0.1, (features, DIMENSIONS))
    softmax = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    bias[1] = np.log(prior / (1 - prior))
    share = np.where(labels == 1, prior / labels.mean(), (1 - prior) / (1 - labels.mean()))
    share = share / len(labels)
    state = [np.zeros_like(x) for x in (embedding, softmax, bias) for _ in range(2)]
    for step in range(1, steps + 1):
        apart = softmax[:, 1] - softmax[:, 0]
        slope = (embedding @ apart).astype(np.float32)
        margin = np.concatenate(
            [_window_sums(slope[g], c) / np.maximum(c, LEAST) for g, c, _ in blocks]
        )
        top, weight = _soft_top(margin, owner, len(texts))
        wrong = (_sigmoid(top + bias[1] - bias[0]) - labels) * share
        # The soft maximum also moves its weights.
        move = wrong[owner] * weight * (1 + (margin - top[owner]) / TOP)
        pull, at = np.zeros(features), 0
        for grams, count, _ in blocks:
            here = move[at : at + len(count)] / np.maximum(count, LEAST)
            pull += np.bincount(grams, np.repeat(here, count), features)
            at += len(count)
        mean = embedding.T @ pull
        slopes = (
            np.outer(pull, apart),
            np.stack([-mean, mean], axis=1),
            np.array([-wrong.sum(), wrong.sum()]),
        )
        for k, (values, slope_of) in enumerate(zip((embedding, softmax, bias), slopes, strict=True)):
            first, second = state[2 * k], state[2 * k + 1]
            first += 0.1 * (slope_of - first)
            second += 0.01 * (slope_of**2 - second)
            rate = 0.1 / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
            if k == 0:  # little-used n-grams stay near zero
                values *= 1 - rate * DECAY
            values -= rate * first / (np.sqrt(second) + 1e-10)
    return ToxicityModel(
        (embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0])
    )


def fit(
    documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS
) -> ToxicityModel:
    """Fit on documents with a ``toxic`` label.

    A document that is labelled more than once counts with its largest label;
    null labels are left out. About ``rows_per_class`` rows of each class, chosen
    by a hash of the id, are drawn from the labels before texts are read. With
    no label, or one class only, the model scores every text with that share.
    """
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    sample, counts = balanced_sample(known, "toxic", "doc_id", most=rows_per_class)
    total = sum(counts.values())
    if len(counts) < 2:
        share = 0.0 if not total else float(max(counts))
        return ToxicityModel(np.zeros(len(SIZES) << BITS, np.float32), 20.0 * (share - 0.5))
    # The sample is bounded, so it may be broadcast to where the texts are.
    rows = few_of_each(texts_of(documents).join(F.broadcast(sample), "doc_id"))
    rows = rows.orderBy("doc_id", "text")
    texts, wanted = [], []
    for row in rows.collect():
        texts.append(row["text"])
        wanted.append(row["toxic"])
    wanted = np.array(wanted)
    if len(set(wanted.tolist())) < 2:
        share = float(wanted.mean()) if len(wanted) else 0.0
        return ToxicityModel(np.zeros(len(SIZES) << BITS, np.float32), 20.0 * (share - 0.5))
    return train(texts, wanted, counts[1] / total)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id`` and ``score`` of every document, empty and null texts included."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch):
        values = shared.value.scores(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(values)], ["doc_id", "score"]
        )

    return map_batches(texts_of(documents), rows, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    learn = labels.where(remainder(F.col("doc_id"), 5) != 0)
    found = score(documents, fit(documents, learn))
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )
