"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Compiled from a model file are three machines: the normaliser (a space becomes
the mark, a mark goes in front), the pieces (a path of characters to an id,
weighted by the piece's score) with a byte path for each character that no
piece spells, and the merge order. The model's pieces come from merges, best
score first, so a sequence of pieces is the model's own exactly if merging the
characters of each two neighbours gives these two back; the merge-order machine
remembers the last piece and gives any other neighbour infinite weight. The
composition with an input is walked once, left to right, and its shortest path
in the tropical semiring (minimum, plus) is the encoding. No piece spans a mark
after another character, so words are walked one by one and remembered.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tripledger.llm.common import map_batches, pieces_of, read_table, texts_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
INFINITE = float("inf")
#: What a worker remembers: words, their parts, and neighbours of pieces.
WORDS = 400_000
PARTS = 400_000
NEIGHBOURS = 400_000
LONG_WORD = 64
PIECE = 1 << 20


class Transducer:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.spelled: list[bytes] = [b""] * size
        self.is_byte = np.zeros(size, bool)
        for k in range(size):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.spelled[k] = k, bytes([value])
                self.is_byte[k] = True
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.ids[piece], self.weight[piece] = k, -model.get_score(k)
                self.spelled[k] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.ids))
        #: The pieces machine: a state is its arcs by character; the empty one marks a piece's end.
        self.start: dict[str, dict] = {}
        for piece in self.ids:
            state = self.start
            for character in piece:
                state = state.setdefault(character, {})
            state[""] = {}
        #: Neighbours inside a piece. No piece and no merge spans any others, so words are cut there.
        self.inside = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            self.words = re.compile(r".+", re.DOTALL)
        else:
            self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.meets: dict[tuple[str, str], bool] = {}

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first, leftmost of equals."""
        parts, weight = list(text), self.weight.get
        pairs = [weight(a + b, INFINITE) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == INFINITE:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = weight(parts[at - 1] + parts[at], INFINITE)
            if at < len(pairs):
                pairs[at] = weight(parts[at] + parts[at + 1], INFINITE)
        return parts

    def neighbours(self, left: str, right: str) -> bool:
        """Whether the merge-order machine lets one piece follow another, or begin."""
        pair = (left, right)
        found = self.meets.get(pair)
        if found is None:
            if len(self.meets) >= NEIGHBOURS:
                self.meets.clear()
            found = self.meets[pair] = self.merged(left + right) == [left, right][not left :]
        return found

    def arcs(self, word: str, start: int) -> list[int]:
        """Ends of the pieces that begin there, the longest last; else of a byte path."""
        if word[start] not in self.weight:
            return [start + 1]
        out, state, end = [], self.start, start
        for character in word[start : start + self.longest]:
            if character not in state:
                break
            state = state[character]
            end += 1
            if "" in state:
                out.append(end)
        return out

    def shortest_path(self, word: str) -> bytes:
        """Ids of a normalised word as native 32-bit integers.

        What merges make of a word's beginning is one sequence of pieces, so
        one state at most is reached at each place at finite weight, and the
        first path to the end, which the composition is searched for depth
        first, is the shortest.
        """
        n, at, before = len(word), 0, ""
        weight, met = self.weight, self.meets.get
        path: list[tuple[int, str]] = []
        dead = [False] * (n + 1)
        open_arcs = [self.arcs(word, 0)] if n else []
        while at < n:
            arcs = open_arcs[-1]
            while arcs:
                end = arcs.pop()
                if dead[end]:
                    continue
                piece = word[at:end]
                if piece not in weight:
                    piece = ""
                follows = not piece or met((before, piece))
                if follows is None:
                    follows = self.neighbours(before, piece)
                if follows:
                    path.append((at, piece))
                    at, before = end, piece
                    open_arcs.append(self.arcs(word, at) if at < n else [])
                    break
            else:
                dead[at] = True
                open_arcs.pop()
                at, _ = path.pop()
                before = path[-1][1] if path else ""
        out: list[int] = []
        for start, piece in path:
            if piece:
                out.append(self.ids[piece])
            else:
                out += [self.byte_ids[b] for b in word[start].encode()]
        return array("i", out).tobytes()

    def path_by_parts(self, word: str) -> bytes:
        """The shortest path, put together from those of the parts that no piece connects."""
        inside, cuts = self.inside, [0]
        for k in range(1, len(word)):
            if word[k - 1 : k + 1] not in inside:
                cuts.append(k)
        cuts.append(len(word))
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = word[a:b]
            ids = self.parts.get(part)
            if ids is None:
                ids = self.shortest_path(part)
                if len(part) <= LONG_WORD:
                    if len(self.parts) >= PARTS:
                        self.parts.clear()
                    self.parts[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        out = []
        for word in self.words.findall(self.normalise(text)):
            ids = self.known.get(word)
            if ids is None:
                ids = self.path_by_parts(word)
                if len(word) <= LONG_WORD:
                    if len(self.known) >= WORDS:
                        self.known.clear()
                    self.known[word] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The inverse path: pieces and bytes are spelled, the first mark goes."""
        spelled = b"".join(map(self.spelled.__getitem__, ids.tolist()))
        return spelled.removeprefix(b" ").decode("utf-8", "replace")


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(path)
    return _COMPILED[path]


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text.

    A null or empty text has no ids; repeated rows stay; ``model`` is a path.
    """
    path = model or public_tokenizers.path(MODEL)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, machine = batch.column("text").to_pylist(), compiled(path)
        for a, b in pieces_of(texts, PIECE, len):
            ids = [machine.encode(t) for t in texts[a:b]]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                ],
                ["doc_id", "ids"],
            )

    return map_batches(texts_of(documents), rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of every row of ids; null ids give an empty text."""
    path = model or public_tokenizers.path(MODEL)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        texts = [
            machine.decode(np.array(ids or [], np.int32)) for ids in batch.column("ids").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts)], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), rows, "doc_id long, text string")


CODED = (
    "doc_id long, n_ids long, n_byte_ids long, ids array<int>, ids_crc32 long, "
    "decoded_sha256 string, round_trip boolean"
)


def encode_and_decode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Ids of every text, with digests of them and of what they decode to.

    ``round_trip``: decoding gives the text back. It does unless the text holds
    the mark itself, which the normaliser cannot tell from a space.
    """
    path = model or public_tokenizers.path(MODEL)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, machine = batch.column("text").to_pylist(), compiled(path)
        for a, b in pieces_of(texts, PIECE, len):
            ids = [machine.encode(t) for t in texts[a:b]]
            back = [machine.decode(each) for each in ids]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([len(each) for each in ids], pa.int64()),
                    pa.array([int(machine.is_byte[each].sum()) for each in ids], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))),
                    pa.array([zlib.crc32(each.astype("<u4").tobytes()) for each in ids], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                    pa.array([t == was for t, was in zip(back, texts[a:b], strict=True)]),
                ],
                [name.split()[0] for name in CODED.split(", ")],
            )

    return map_batches(texts_of(documents), rows, CODED)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(read_table(spark, sf_dir, "documents"))
