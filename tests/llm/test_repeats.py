import hashlib
import random
from collections import Counter

import cases
import numpy as np
from tripledger.llm import repeats

L = repeats.LENGTH


def brute(made):
    """Kept bytes and removed runs of each row."""
    first = {}
    for i, t in made:
        data = (t or "").encode()
        if i is not None:
            for k in range(len(data) - L + 1):
                gram = data[k : k + L]
                first[gram] = min(i, first.get(gram, i))
    out = []
    for i, t in made:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - L + 1):
            if i is not None and first[data[k : k + L]] < i:
                gone[k : k + L] = True
        kept = bytes(c for c, g in zip(data, gone, strict=False) if not g)
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(data) else 0
        out.append((i, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared(seed):
    rng = random.Random(seed)
    made = cases.rows(seed)
    hot = cases.prose(rng, 40)
    for k in range(60):  # a passage that many documents share, cut at any place
        a, b = sorted(rng.sample(range(len(hot)), 2))
        made.append((3000 + rng.randrange(40), cases.prose(rng, 15) + hot[a:b] + cases.prose(rng, 15)))
    made += [(4000, "x" * 400), (4001, "x" * 49), (4002, "y" + "x" * 60), (4003, "xy" * 90),
             (4004, "z" * 10 + "xy" * 40), (4005, "\0" * 80), (4006, "\0" * 51 + "x" * 50)]
    return made


def test_removed_bytes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLOT_BYTES", 1 << 12)
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 1 << 14)
    for seed in (1, 2):
        made = shared(seed)
        rows = repeats.without_repeats(cases.table(spark, made), "lang").drop("kept").collect()
        assert Counter(tuple(r)[:5] for r in rows) == Counter(brute(made))


def test_removed_bytes_at_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLOT_BYTES", 1 << 12)
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 1 << 14)
    for hot in (0, 3):
        monkeypatch.setattr(repeats, "HOT", hot)
        made = shared(1)
        rows = repeats.without_repeats(cases.table(spark, made), "lang").drop("kept").collect()
        assert Counter(tuple(r)[:5] for r in rows) == Counter(brute(made))


def test_rows_that_come_very_often(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLOT_BYTES", 1 << 14)
    monkeypatch.setattr(repeats, "MANY", 20)
    made = shared(1)
    long = next(t for _, t in made if t and len(t) > 500)
    made += [made[2]] * 300 + [(None, long)] * 90 + [(9000, long)] * 50 + [(9001, "é" * 70)] * 30
    docs = cases.table(spark, made)
    rows = repeats.without_repeats(docs, "lang").drop("kept").collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter(brute(made))
    assert all(r["lang"] == ("en" if (r["doc_id"] or 0) % 2 else None) for r in rows)


def test_segments_of_a_hot_anchor_part(spark, monkeypatch):
    """One phrase between varying words: its distinct segments do not meet in one bucket."""
    monkeypatch.setattr(repeats, "SLOT_BYTES", 1 << 14)
    monkeypatch.setattr(repeats, "HOT", 100)
    rng = random.Random(5)
    phrases = [cases.prose(rng, 12)[: repeats.ANCHOR] for _ in range(3000)]
    phrase = min(phrases, key=lambda p: repeats._gram_hashes(np.frombuffer(p.encode(), np.uint8))[0])
    made = [(k, f"{cases.prose(rng, 8)} {phrase} {cases.prose(rng, 8)}") for k in range(1500)]
    made += [(5000, made[7][1]), (5001, made[9][1][3:])]
    slots, buckets, spread = repeats._setting(cases.table(spark, made))
    masks = repeats._shared_anchors(slots, buckets)
    sent = repeats._sent_segments(slots, masks, buckets, spread, part=True)
    rows = sent.selectExpr("bucket", "length(data) n").groupBy("bucket").sum("n").collect()
    assert max(r[1] for r in rows) < 2 * sum(r[1] for r in rows) / spread
    got = repeats.without_repeats(cases.table(spark, made)).drop("kept").collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(brute(made))


def test_blocks_of_anchors_join_up(monkeypatch):
    data = np.frombuffer(cases.prose(random.Random(1), 3000).encode(), np.uint8)
    whole = repeats.anchors(data)
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    parted = repeats.anchors(data)
    assert all((a == b).all() for a, b in zip(whole, parted, strict=True))


def test_kept_text_has_no_split_characters(spark):
    made = [(1, "é" * 60), (2, "aé" + "é" * 60 + "b"), (3, "ü" + "é" * 40)]
    rows = {r["doc_id"]: r for r in repeats.without_repeats(cases.table(spark, made)).collect()}
    assert rows[2]["kept"] == "ab" and rows[2]["n_removed"] == 122
    assert rows[3]["kept"] in ("ü", "") and rows[1]["kept"] == made[0][1]


def test_interval_tree_against_brute_force():
    rng = random.Random(5)
    base = bytes(rng.choices(b"ab", k=200))
    contents = sorted(
        {base[a : a + rng.randint(50, 80)] for a in rng.choices(range(120), k=30)}
        | {b"a" * 60, b"a" * 55 + b"b" * 5, b"ba" * 35}
    )
    least = np.arange(len(contents))
    tree = repeats.SuffixTree(contents, least, np.zeros(len(contents), bool))
    group, segment, offset, depth, low = tree.members()
    suffixes = [(c[k:], s, k) for s, c in enumerate(contents) for k in range(len(c) - L + 1)]
    members = {}
    for g, s, o, d, m in zip(*(x.tolist() for x in (group, segment, offset, depth, low)), strict=True):
        members.setdefault((g, d, m), set()).add((s, o))
    got = {}
    for (_, d, m), found in members.items():
        s, o = next(iter(found))
        text = contents[s][o : o + d]
        assert found == {(t, k) for x, t, k in suffixes if x.startswith(text)}
        assert m == min(t for t, _ in found)
        got[text] = found
    # Every repeat that cannot be made longer on either side is there.
    for x, s, k in suffixes:
        for d in range(L, len(x) + 1):
            found = {(t, j) for y, t, j in suffixes if y.startswith(x[:d])}
            after = {contents[t][j + d : j + d + 1] for t, j in found}
            before = {contents[t][j - 1 : j] if j else (t, j) for t, j in found}
            if len(found) > 1 and (len(after) > 1 or b"" in after) and len(before) > 1:
                assert x[:d] in got


def test_occurrences_of_maximal_repeats(spark):
    made = [(i, t) for i, t in shared(3) if i is not None]
    texts = {}
    for i, t in made:
        texts.setdefault(i, []).append((t or "").encode())
    rows = repeats.maximal_repeats(cases.table(spark, made)).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["repeat"], r["length"]), set()).add((r["doc_id"], r["place"]))
    assert groups
    for (_, n), places in groups.items():
        strings = {
            d[p : p + n] for i, p in places for d in texts[i] if len(d[p : p + n]) == n
        }
        common = [s for s in strings if all(any(d[p : p + n] == s for d in texts[i]) for i, p in places)]
        assert n >= L and common
    # Together they cover what several documents share.
    for i, data, removed, _, _ in brute(made):
        if removed:
            assert any(i == doc for places in groups.values() for doc, _ in places)


def test_empty_table(spark):
    assert repeats.without_repeats(cases.empty(spark)).count() == 0
    assert repeats.maximal_repeats(cases.empty(spark)).count() == 0
