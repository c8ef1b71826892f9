import random
import re
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from compare import differences
from pyspark.sql import functions as F
from tripledger.llm import collocations
from tripledger.session import Scratch

LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def counts(rows):
    """Occurrences of all phrases of up to five words by language, and of all words."""
    found, total = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        held = found.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                held.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return found, total


def inside(short, long):
    return any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1))


def brute(rows, least, top):
    found, total = counts(rows)
    out = []
    for lang, held in found.items():
        known = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in known.items():
            if any(len(q) > len(p) and b >= a and inside(p, q) for q, b in known.items()):
                continue
            score, _, l, r = min(
                (1000 * a * total[lang] // (held[p[:k]] * held[p[k:]]), k, held[p[:k]], held[p[k:]])
                for k in range(1, len(p))
            )
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    words = ["The", "the", "of", "new", "york", "São", "x-1", "\xa0", "a b", "É", "中", "…"]
    marks = [" ", " ", " ", " ", " ", " ", "\t", "  ", ". ", ",", ";", "! ", "\n", "\x0b", "\r\n", " : "]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            text += " new york stock exchange of the world"
        rows.append((rng.choice(["", " "]) + text, ["en", "de", None, "und"][k % 4]))
    return rows + [(None, "en"), ("", None), ("... !", "en"), ("z" * 5000 + " z", "en"), rows[0], rows[0]]


def table(spark, rows):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    return frame.selectExpr("*", *(f"'x' AS {c}" for c in ("n", "size", "phrase", "shard", "words", "ids", "score")))


@pytest.mark.parametrize("piece, shards, bits, least", [(300, 4, 1 << 16, 5), (2000, 3, 64, 3), (1 << 20, 4, 1 << 26, 2)])
def test_against_brute_force(spark, monkeypatch, piece, shards, bits, least):
    # 64 bits hold every phrase: the scans let all in and the counts stay right.
    monkeypatch.setattr(collocations, "PIECE", piece)
    rows = made(piece)
    got = collocations.collocations(
        table(spark, rows).repartition(3), least, top=60, count=shards, bits=bits
    )
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 60)


def test_counts_of_every_frequent_phrase(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PIECE", 200)
    rows = made(7, 80)
    scratch = Scratch(spark, "test")
    staged = scratch.stage(collocations.shards(table(spark, rows), 5), "shards")
    got = collocations.phrase_counts(staged, scratch, least=3, count=5, bits=1 << 12).collect()
    found, _ = counts(rows)
    expected = {(lang, " ".join(p)): n for lang, held in found.items() for p, n in held.items() if n >= 3}
    assert {(r["lang"], r["phrase"]): r["n"] for r in got} == expected


def test_scan_counts_only_phrases_of_frequent_parts():
    words = pa.array(["a", "b", "c"])
    ids = np.array([0, 1, 2, -1, 0, 1], np.int32)
    own = collocations._word_hashes(words.to_pylist(), "en")
    frequent, none = collocations.Frequent(1 << 16), collocations.Frequent(1 << 16)
    for word, bit in frequent.places(own[:2]):
        for w, b in zip(word, bit, strict=True):
            frequent.words[w] |= np.uint64(1 << int(b))
    assert list(collocations.counted(words, own, ids, frequent, none, False, 5)) == []
    found = list(collocations.counted(words, own, ids, frequent, frequent, False, 5))
    assert [(s, p.to_pylist(), n.tolist()) for s, p, n in found] == [(2, ["a b"], [2])]


def test_wide_products(spark):
    """Counts whose products pass 64 bits are divided exactly."""
    big = 10**13
    row = spark.range(1).select(
        *(F.lit(v).cast("long").alias(c) for c, v in (("a", big - 7), ("n", 3 * big + 1), ("l", big - 3), ("r", big + 9)))
    )
    assert row.select(F.expr(collocations.SCORE)).first()[0] == 1000 * (big - 7) * (3 * big + 1) // ((big - 3) * (big + 9))


def test_empty_table(spark):
    assert collocations.collocations(cases.empty(spark)).count() == 0


def test_query_equals_its_sql_on_larger_tables(spark):
    sf = "/root/testdata/sf0.01"
    assert differences(collocations.op11_collocations(spark, sf), collocations.ORACLE, sf) == []
