import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tripledger.llm import pieces

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_shortest_paths_are_the_models_encodings(model):
    machine, rng = pieces.Transducer(PATH), random.Random(8)
    letters = "abcdefgh  \n\tthe er in é①ñßΣ中😀.,!'\"0123"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [" " * k + "x" + " " * k for k in range(40)] + ["ab" * 500, "▁a▁", "\0"]
    texts += [t for _, t in cases.rows() if t]
    for text in texts:
        ids = machine.encode(text)
        assert ids.tolist() == model.encode(text), repr(text)
        if "▁" not in text:
            assert machine.decode(ids) == text


def test_paths_are_shortest_among_all_segmentations():
    machine = pieces.Transducer(PATH)

    def ways(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in machine.ids:
                for rest in ways(word[k:]):
                    yield [word[:k], *rest]

    for word in ("▁there", "▁▁an", "▁tion"):
        allowed = [
            w for w in ways(word) if all(machine.neighbours(a, b) for a, b in zip(w, w[1:], strict=False))
        ]
        best = min(allowed, key=lambda w: sum(machine.weight[p] for p in w))
        got = np.frombuffer(machine.shortest_path(word), np.int32).tolist()
        assert got == [machine.ids[p] for p in best]


def test_full_memory_starts_anew(model, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 5)
    monkeypatch.setattr(pieces, "NEIGHBOURS", 5)
    machine = pieces.Transducer(PATH)
    text = cases.prose(random.Random(1), 200)
    assert machine.encode(text).tolist() == model.encode(text)


def test_parts_that_no_piece_connects_are_walked_once(model, monkeypatch):
    """Words of known parts in new company (punctuation, lines) are not walked again."""
    machine, rng = pieces.Transducer(PATH), random.Random(3)
    walked = []
    path = machine.shortest_path
    monkeypatch.setattr(machine, "shortest_path", lambda part: walked.append(part) or path(part))
    names = [cases.prose(rng, 1) for _ in range(30)]
    text = " ".join(f"{rng.choice(names)}.\n{rng.choice(names)}" for _ in range(600))
    assert machine.encode(text).tolist() == model.encode(text)
    assert len(walked) == len(set(walked)) <= 2 * len(names) + 10
    assert all(machine.merged(piece) == [piece] for piece in machine.ids)


def test_operator_on_odd_documents(spark, model):
    made = cases.rows()
    rows = pieces.encode_and_decode(cases.table(spark, made)).collect()
    assert len(rows) == len(made) and all(r["round_trip"] for r in rows)
    held = {}
    for i, t in made:
        held.setdefault(i, []).append(model.encode(t or ""))
    for r in rows:
        assert r["ids"] in held[r["doc_id"]] and r["n_ids"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    back = pieces.decode(pieces.encode(cases.table(spark, made))).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in back) == sorted(
        (-1 if i is None else i, t or "") for i, t in made
    )
    assert pieces.encode_and_decode(cases.empty(spark)).count() == 0
    assert pieces.decode(pieces.encode(cases.empty(spark))).count() == 0
