"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over
hashed byte n-grams (a naive Bayes log-likelihood ratio) tells the languages
with a 1 from those with a 0. Decoding is loss-weighted: a codeword's loss is
the sum of the logistic losses of its bits, each weighted by how much better
than chance the bit's classifier is on the rows it was fitted on. The nearest
codeword wins; a small lead over the next one flags ambiguity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.common import (
    balanced_sample,
    hashed_grams,
    map_batches,
    pieces_of,
    read_table,
    remainder,
    texts_of,
)

UNDETERMINED = "und"
SIZES = (2, 3)
BITS = 14
#: Labelled rows of each language that the classifiers are fitted on, about.
ROWS_PER_LANGUAGE = 1500
#: A lead in score below this is ambiguous.
AMBIGUOUS = 0.2
PIECE = 1 << 20
ASCII_LETTER = re.compile("[A-Za-z]")


def code_words(languages: int) -> np.ndarray:
    """Rows of +1 and -1. Few languages take every distinct split; many take random ones.

    The random code is the best of 64 seeded draws by the smallest distance
    between two rows.
    """
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 5:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if s >> k & 1 else -1 for s in splits] for k in range(languages)])
    width = 6 * int(np.ceil(np.log2(languages)))
    best, far = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1, 1], (languages, width))
        apart = (width - code @ code.T) // 2 + np.eye(languages, dtype=int) * width
        usable = (np.abs(code.sum(axis=0)) < languages).all()
        if usable and apart.min() > far:
            best, far = code, int(apart.min())
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # a row of log-likelihood ratios for each hashed n-gram
    scale: np.ndarray  # of each bit's margin
    trust: np.ndarray  # of each bit

    def margins(self, texts: list[str]) -> np.ndarray:
        """Calibrated margins, a row for each text and a column for each bit."""
        total, n = gram_sums(texts, self.weights)
        return total / np.sqrt(np.maximum(n, 1))[:, None] * self.scale

    def scores(self, texts: list[str]) -> np.ndarray:
        """Share of each language, a row for each text."""
        margin = self.margins(texts)
        loss = np.zeros((len(texts), len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = np.logaddexp(0, -margin * word) @ self.trust
        lead = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return lead / lead.sum(axis=1, keepdims=True)


def _buffers(texts: list[str]):
    """Texts in lower case as bytes, a space on either side, in pieces of bounded size."""
    for a, b in pieces_of(texts, PIECE, len):
        each = [f" {t.lower()} ".encode() for t in texts[a:b]]
        size = np.fromiter(map(len, each), np.int64, len(each))
        yield a, b, np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size


def gram_sums(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights of each text's n-grams, and their number. Whole texts count."""
    total = np.zeros((len(texts), weights.shape[1]))
    count = np.zeros(len(texts))
    for a, b, data, start, size in _buffers(texts):
        if len(data) > 8 * PIECE:  # one very long text: count its n-grams block by block
            found = _count_grams(data)
            total[a:b], count[a:b] = found @ weights, found.sum()
            continue
        for k, width in enumerate(SIZES):
            grams = hashed_grams(data, width, BITS)
            rows = weights[grams + (k << BITS)]
            inside = np.maximum(size - width + 1, 0)
            # Grams that straddle two texts are left out of both.
            bounds = np.stack([start, start + inside], axis=1).ravel()
            at = np.minimum(bounds, max(len(rows) - 1, 0))
            if len(rows):
                sums = np.add.reduceat(rows, at, axis=0)[::2]
                last = bounds[1::2] > at[1::2]  # reduceat cannot name the end of the rows
                sums[last] = [rows[s:].sum(axis=0) for s in at[::2][last]]
                total[a:b] += np.where(inside[:, None] > 0, sums, 0)
            count[a:b] += inside
    return total, count


def _count_grams(data: np.ndarray) -> np.ndarray:
    found = np.zeros(len(SIZES) << BITS, np.int64)
    for at in range(0, len(data), PIECE):
        for k, width in enumerate(SIZES):
            grams = hashed_grams(data[at : at + PIECE + width - 1], width, BITS)
            found[k << BITS : (k + 1) << BITS] += np.bincount(grams, minlength=1 << BITS)
    return found


def gram_counts(texts: list[str]) -> np.ndarray:
    return sum(
        (_count_grams(data) for _, _, data, _, _ in _buffers(texts)),
        np.zeros(len(SIZES) << BITS, np.int64),
    )


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Fit on ``doc_id``, ``text`` and non-null ``lang``.

    About ``rows_per_language`` rows of each language are used, chosen by a hash
    of id and text, repeated rows once; their texts stay on the executors, which return n-gram counts
    and margins only.
    """
    labelled = labelled.select("doc_id", "text", "lang")
    sample, counts = balanced_sample(labelled, "lang", "doc_id", "text", most=rows_per_language)
    sample = sample.distinct()
    languages = sorted(counts)
    code = code_words(len(languages))
    if not code.shape[1]:
        empty = np.zeros(0)
        return LanguageModel(languages, code, np.zeros((len(SIZES) << BITS, 0)), empty, empty)

    def count(batch: pa.RecordBatch):
        texts, names = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        kinds = sorted(set(names))
        packed = [
            gram_counts([t for t, n in zip(texts, names, strict=True) if n == kind]).tobytes()
            for kind in kinds
        ]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(packed)], ["lang", "counts"])

    seen = np.zeros((len(languages), len(SIZES) << BITS))
    for row in map_batches(sample, count, "lang string, counts binary").toLocalIterator():
        seen[languages.index(row["lang"])] += np.frombuffer(row["counts"], np.int64)
    share = (seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True)
    weights = np.stack(
        [np.log(share[bit > 0].mean(axis=0) / share[bit < 0].mean(axis=0)) for bit in code.T],
        axis=1,
    ).astype(np.float32)
    plain = LanguageModel(
        languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1])
    )

    def margin(batch: pa.RecordBatch):
        values = plain.margins(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(list(values), pa.list_(pa.float64()))],
            ["lang", "margins"],
        )

    rows = map_batches(sample, margin, "lang string, margins array<double>").collect()
    side = code[[languages.index(r["lang"]) for r in rows]]
    values = np.array([r["margins"] for r in rows])
    right = ((values * side) > 0).mean(axis=0)
    # One scale for each bit, so that its usual margin is worth four in log-odds.
    plain.scale = 4 / np.maximum(np.median(np.abs(values), axis=0), 1e-9)
    plain.trust = np.clip(2 * right - 1, 0.05, 1)
    return plain


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``ambiguous`` for every document.

    Texts that are null or have no letter are ``und`` with score 0, as is
    everything where no language was learned. Nothing but the text is used.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch):
        model, texts = shared.value, batch.column("text").to_pylist()
        known = np.array([bool(model.languages) and has_letter(t) for t in texts])
        names, best, lead = np.full(len(texts), UNDETERMINED, object), [], []
        best, lead = np.zeros(len(texts)), np.ones(len(texts))
        if model.languages:
            scores = model.scores(texts)
            order = np.argsort(-scores, axis=1, kind="stable")
            top = np.take_along_axis(scores, order, axis=1)
            names = np.where(known, np.array(model.languages, object)[order[:, 0]], names)
            best = np.where(known, top[:, 0], 0)
            lead = top[:, 0] - (top[:, 1] if top.shape[1] > 1 else 0)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(names, pa.string()),
                pa.array(best),
                pa.array(known & (lead < AMBIGUOUS)),
            ],
            ["doc_id", "lang_pred", "score", "ambiguous"],
        )

    return map_batches(
        texts_of(documents),
        rows,
        "doc_id long, lang_pred string, score double, ambiguous boolean",
    )


def op4_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    learn = documents.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    found = identify(documents, fit(texts_of(learn, "lang")))
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        "lang_pred",
        "score",
        "ambiguous",
    )
