import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tripledger.llm import encoding, tokenids

PATH = public_tokenizers.path(tokenids.TOKENIZER)
ODD = "aAbzZéÉßÿ'’stredvm019 \t\n\x0b\x0c\r\x1c\x85  .,;:!?-<|>中文字😀́̈ñİıΣσςﬁ‍\u0000×÷µªº²"


def library_ids(texts):
    plain = Tokenizer.from_file(PATH)
    return [[*e.ids, 1] for e in plain.encode_batch_fast(texts, add_special_tokens=False)]


def our_ids(texts):
    out = []
    for ids, starts in encoding.encoder(PATH).encode(pa.array(texts, pa.string()), 1):
        out += [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return out


def test_parts_give_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr(encoding, "PIECE", 500)
    monkeypatch.setattr(encoding, "KNOWN", 300)
    rng = random.Random(5)
    words = ["<|endoftext|>", "<|startoftext|>", "'s", "'RE", "<|", "|>", "don't", "x1y22"]
    texts = [
        "".join(rng.choice(ODD) if rng.random() < 0.9 else rng.choice(words) for _ in range(n % 40))
        for n in range(5000)
    ]
    texts += [t or "" for _, t in cases.rows()]
    assert our_ids(texts) == library_ids(texts)
    assert our_ids([]) == []


def brute(rows):
    texts = [t or "" for _, t in rows]
    made = [
        ((i is not None, i or 0), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), i)
        for (i, _), ids in zip(rows, library_ids(texts), strict=True)
    ]
    out, start = [], 0
    for _, n, crc, i in sorted(made, key=lambda r: r[:3]):
        out.append((i, start, n, crc))
        start += n
    return out


def summary(frame):
    rows = frame.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


def test_files_hold_every_document_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "BLOCK_BYTES", 2_000)
    made = cases.rows()
    path = f"{tmp_path}/ids"
    tokenids.write_ids(cases.table(spark, made).repartition(3), path)
    assert summary(tokenids.read_ids(spark, path)) == brute(made)


def test_hot_id_is_spread_over_parts(spark, tmp_path):
    made = [(7, f"text {k % 50} of one id") for k in range(3000)] + [(k, "other") for k in range(20)]
    path = f"{tmp_path}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenids.write_ids(cases.table(spark, made).repartition(4), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert summary(tokenids.read_ids(spark, path)) == brute(made)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.where("array_contains(doc_ids, 7)").select("part").distinct().count() > 1


def test_lookup_reads_single_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "BLOCK_DOCUMENTS", 5)
    made = [(k, cases.prose(random.Random(k), 60)) for k in range(400)]
    path = f"{tmp_path}/ids"
    tokenids.write_ids(cases.table(spark, made), path)
    everything = {r[0]: r for r in summary(tokenids.read_ids(spark, path))}
    got = summary(tokenids.lookup(spark, path, [3, 77, 399, 5000]))
    assert got == [everything[k] for k in (3, 77, 399)]
    assert tokenids.lookup(spark, path, []).count() == 0


def test_shared_dictionary_shortens_short_documents(spark, tmp_path):
    made = [(k, cases.prose(random.Random(k % 900), 40)) for k in range(1500)]
    path = f"{tmp_path}/ids"
    tokenids.write_ids(cases.table(spark, made), path)
    content = bytes(spark.read.parquet(f"{path}/dictionary").first()["content"])
    assert content
    held = spark.read.parquet(f"{path}/blocks").agg(F.sum(F.length("frames"))).first()[0]
    import zstandard

    alone = zstandard.ZstdCompressor(level=tokenids.LEVEL)
    plain = sum(len(alone.compress(np.array(i, "<u2").tobytes())) for i in library_ids([t for _, t in made]))
    assert held < 0.8 * plain


def test_another_dictionary_is_an_error(spark, tmp_path):
    path = f"{tmp_path}/ids"
    tokenids.write_ids(cases.table(spark), path)
    other = spark.createDataFrame([("0" * 64, bytearray(b"x"))], "sha256 string, content binary")
    other.write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError, match="hash"):
        tokenids.read_ids(spark, path)


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/ids"
    tokenids.write_ids(cases.empty(spark), path)
    assert tokenids.read_ids(spark, path).count() == 0
