"""Token ids of texts, each distinct part of a word encoded once.

The tokenizer never joins what white space parts. A batch is split into words and
these into parts in Arrow, with a dictionary of each; the library encodes the
parts that a worker does not remember, and the ids of the texts are gathered from
those of their words.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tripledger.llm.common import pieces_of

#: Parts that a worker remembers at most; beyond that those not seen lately go.
KNOWN = 400_000
#: Bytes of text that are encoded at once; a longer text stands alone. What a worker holds
#: besides its batch and its known parts is some 25 times that.
PIECE = 1 << 21

# How the tokenizer parts a text of these characters.
PLAIN_WORD = "^[!-~À-ÖØ-öø-ÿ]+$"
PARTS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+)"
SPECIAL = "<|"


def gathered(
    store: np.ndarray, count: np.ndarray, index: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``store`` that ``index`` names, one after another, and where each begins.

    ``count`` has the length of each run of the store; the second array of the
    result has one entry more than ``index``.
    """
    number = count[index]
    upto = np.concatenate([[0], np.cumsum(number)])
    at = np.repeat((np.cumsum(count) - count)[index] - upto[:-1], number)
    at += np.arange(upto[-1])
    return store[at], upto


def _plain(words: pa.Array) -> pa.Array:
    return pc.and_not(
        pc.match_substring_regex(words, PLAIN_WORD), pc.match_substring(words, SPECIAL)
    )


class Encoder:
    """Ids of a tokenizer file as 32-bit numbers.

    The file is one whose tokenizer drops white space and parts plain words as
    ``PARTS`` does; words with other characters go through the whole tokenizer.
    Parts are remembered in two generations: when the newer one is full the
    older one is forgotten, so frequent parts stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        # Characters beyond ASCII as the model spells their bytes.
        self.spelling = {
            code: byte_level.pre_tokenize_str(chr(code))[0][0] for code in range(0x80, 0x100)
        }
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, part: str, plain: bool) -> bytes:
        if plain:
            found = self.model.tokenize(part if part.isascii() else part.translate(self.spelling))
            return array("I", [token.id for token in found]).tobytes()
        return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _parts(self, parts: pa.Array) -> list[bytes]:
        words = parts.to_pylist()
        found = list(map(self.newer.get, words))
        new = [k for k, ids in enumerate(found) if ids is None]
        plain = _plain(parts.take(pa.array(new, pa.int64()))).to_pylist()
        for k, is_plain in zip(new, plain, strict=True):
            word = words[k]
            found[k] = self.older.get(word) or self._encoded(word, is_plain)
            if len(self.newer) >= KNOWN // 2:
                self.older, self.newer = self.newer, {}
            self.newer[word] = found[k]
        return found

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and their number for each word."""
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), PARTS, r"\1 ")
        split = pc.ascii_split_whitespace(pc.if_else(_plain(words), spaced, words))
        each = split.flatten().dictionary_encode()
        found = self._parts(each.dictionary)
        count = np.fromiter(map(len, found), np.int64, len(found)) // 4
        store = np.frombuffer(b"".join(found), np.uint32)
        index = each.indices.to_numpy(zero_copy_only=False)
        ids, upto = gathered(store, count, index)
        return ids, np.diff(upto[split.offsets.to_numpy(zero_copy_only=False)])

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of consecutive texts, each with ``end`` behind it, and where each begins.

        The second array has one entry more than there are texts in the piece.
        """
        texts = texts.cast(pa.string())
        size = pc.binary_length(texts).to_pylist()
        for a, b in pieces_of(size, PIECE, int):
            yield self._piece(texts.slice(a, b - a), end)

    def _piece(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        each = split.flatten().dictionary_encode()
        del split  # the words themselves are not needed again
        store, count = self._words(each.dictionary)
        ids, upto = gathered(store, count, each.indices.to_numpy(zero_copy_only=False))
        close = upto[offsets[1:] - offsets[0]]
        starts = np.concatenate([[0], close + np.arange(1, len(texts) + 1)])
        return np.insert(ids, close, end).astype("<u4", copy=False), starts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
