import random
import tracemalloc
import zlib
from collections import Counter

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tripledger.llm import encoding, packing
from tripledger.llm.common import map_batches


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, made, tokenizer):
    """Every id lies in one piece; sequences have no gap; returns their lengths."""
    texts = {}
    for i, t in made:
        texts.setdefault(i, []).append(ids_of(tokenizer, t))
    left = {i: Counter(map(tuple, held)) for i, held in texts.items()}
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        ids = [
            held[r["start"] : r["start"] + r["length"]]
            for held in texts[r["doc_id"]]
            if len(held) == r["doc_tokens"]
        ]
        assert r["ids_crc32"] in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    for (i, total), some in pieces.items():
        times = sum(n for held, n in left[i].items() if len(held) == total)
        covered = Counter(k for r in some for k in range(r["start"], r["start"] + r["length"]))
        assert covered == {k: times for k in range(total)}
    assert sum(r["length"] for r in rows) == sum(len(x) for held in texts.values() for x in held)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    lengths = []
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        lengths.append(at)
    assert max(lengths) <= packing.SEQUENCE
    return lengths


def test_pack_odd_documents(spark, tokenizer):
    made = cases.rows(n=200)
    rows = packing.pack(cases.table(spark, made)).collect()
    lengths = check(rows, made, tokenizer)
    assert all(n & (n - 1) == 0 for n in lengths)  # no padding at all


def test_pack_is_exact_for_many_lengths(spark, tokenizer):
    rng = random.Random(6)
    made = [(k, cases.prose(rng, int(rng.paretovariate(0.8) * 20) % 1500 + 1)) for k in range(700)]
    rows = packing.pack(cases.table(spark, made).repartition(5)).collect()
    lengths = check(rows, made, tokenizer)
    assert all(n & (n - 1) == 0 for n in lengths)


def test_most_documents_stay_whole(spark, tokenizer):
    rows = packing.op2_pack(spark, "/root/testdata/sf0.01").collect()
    short = {r["doc_id"]: r["doc_tokens"] for r in rows if r["doc_tokens"] < packing.SEQUENCE}
    parts = Counter(r["doc_id"] for r in rows if r["doc_id"] in short)
    assert np.mean([n == 1 for n in parts.values()]) > 0.8


def test_knapsack_and_linear_program():
    rng = np.random.default_rng(0)
    size, value = np.array([3, 5, 7, 11]), rng.random(4)
    best, taken = packing.knapsack(value, size, 30)
    brute = max(
        value @ [a, b, c, d]
        for a in range(11) for b in range(7) for c in range(5) for d in range(3)
        if size @ [a, b, c, d] <= 30
    )
    assert np.isclose(best, brute) and size @ taken <= 30 and np.isclose(value @ taken, best)
    size = np.arange(1, 65)
    demand = rng.integers(1, 400, 64).astype(float)
    columns, count = packing.patterns_for(size, demand, 256)
    assert np.allclose(columns @ count, demand) and (size @ columns <= 256).all()
    assert count.sum() <= size @ demand / 256 + 1


def test_empty_table(spark):
    assert packing.pack(cases.empty(spark)).count() == 0


def test_hot_row_and_null_ids(spark, tokenizer):
    rng = random.Random(7)
    copy = cases.prose(rng, 90)
    made = [(5, copy)] * 600 + [(None, cases.prose(rng, rng.randint(1, 300))) for _ in range(300)]
    made += [(k, cases.prose(rng, 40)) for k in range(10, 300)]
    rows = packing.pack(cases.table(spark, made).repartition(4)).collect()
    lengths = check(rows, made, tokenizer)
    assert all(n & (n - 1) == 0 for n in lengths)


def test_very_long_text(spark, tokenizer):
    rng = random.Random(8)
    made = [(1, cases.prose(rng, 60_000)), (2, "é" * 300_000), (3, "one"), (4, "x " * 100_000)]
    rows = packing.pack(cases.table(spark, made)).collect()
    assert all(n & (n - 1) == 0 for n in check(rows, made, tokenizer))


def test_memory_of_the_encoder_does_not_follow_the_batch():
    rng = random.Random(9)
    texts = pa.array([cases.prose(rng, 4_000) for _ in range(500)], pa.string())
    assert texts.nbytes > 1 << 23
    encoder = encoding.Encoder(public_tokenizers.path(packing.TOKENIZER))
    list(map(len, encoder.encode(texts[:1], 1)))
    before, pool = pa.default_memory_pool(), pa.proxy_memory_pool(pa.default_memory_pool())
    pa.set_memory_pool(pool)
    tracemalloc.start()
    try:
        assert sum(len(starts) - 1 for _, starts in encoder.encode(texts, 1)) == len(texts)
        held = tracemalloc.get_traced_memory()[1] + pool.max_memory()
    finally:
        tracemalloc.stop()
        pa.set_memory_pool(before)
    assert held < 64 << 20


def test_batches_of_long_texts_are_bounded(spark):
    def seen(batch):
        sizes = [pa.array([batch.num_rows]), pa.array([batch.nbytes])]
        yield pa.RecordBatch.from_arrays(sizes, ["n", "size"])

    long = spark.range(0, 9_000, 1, 1).select("id", F.repeat(F.lit("x"), 3_000).alias("text"))
    rows = map_batches(long, seen, "n long, size long").collect()
    assert sum(r["n"] for r in rows) == 9_000
    assert max(r["size"] for r in rows) < 5 << 20
