"""Exact repeats across documents by enhanced suffix arrays and their interval tree.

Documents are dealt to slots of a few megabytes. Repeats of at least ``LENGTH``
bytes are found in three steps, each an exchange of packed rows between slots
and buckets.

1. Anchors. The lowest-hashed ``ANCHOR``-byte string inside each ``LENGTH``-byte
   window is its anchor. Equal windows have equal anchors, so only anchors that
   two documents share can lie in a repeat. A slot sends each hash once; a
   bucket of hashes tells a slot which of them others have.
2. Segments. The consecutive windows of a document that share one such anchor
   make a segment. Of equal segments of a slot, those outside the smallest
   doc_id are repeats at once, and the smallest one's is sent to its anchor's
   bucket. There the suffixes of all distinct segments that still have
   ``LENGTH`` bytes are sorted, their common prefixes are computed, and a stack
   scan yields the tree of common-prefix intervals. An interval whose suffixes
   have more than one left neighbour is a maximal repeat; at a segment's first
   byte the left neighbour is unknown and counts as different.
3. Answers. Buckets send each slot the repeats of its own segments.

So a passage that very many documents share reaches a bucket once for each slot.
An anchor that stands more than ``HOT`` times may have as many different segments.
What ``without_repeats`` asks of these is only which ``LENGTH``-byte windows a
smaller doc_id has, so a slot sends the hashes of their distinct windows instead,
each with its least doc_id, to buckets by the window's hash: equal windows meet,
and the windows of one anchor are spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.common import broadcast_within, fresh, read_table, texts_of
from tripledger.session import Scratch

LENGTH = 50
ANCHOR = 20
WINDOW = LENGTH - ANCHOR + 1
LONGEST = LENGTH + WINDOW - 1  # of a segment
#: Bytes of text for each slot, bucket of anchors and bucket of segments, about.
SLOT_BYTES = 4 << 20
ANCHOR_BYTES = 16 << 20
SEGMENT_BYTES = 2 << 20
#: Occurrences of an anchor beyond which its windows are dealt out one by one.
HOT = 20_000
BLOCK = 1 << 18
PIECE_BYTES = 1 << 19
ROWS = 1 << 15
INDEX = np.uint64((1 << 24) - 1)
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray, size: int = ANCHOR, seed: int = 1) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes, by doubling."""
    hashes, width = (data.astype(np.uint64) + np.uint64(seed)) * _MULTIPLY, 1

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = left * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        out += right
        out *= _MULTIPLY
        out ^= out >> np.uint64(32)
        return out

    powers = {1: hashes}
    while 2 * width <= size:
        hashes = joined(hashes[:-width], hashes[width:])
        width *= 2
        powers[width] = hashes
    done, out = width, hashes
    for width in sorted(powers, reverse=True):
        if done + width <= size:
            n = len(data) - done - width + 1
            out = joined(out[:n], powers[width][done : done + n])
            done += width
    return out


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    held, out = 1, values
    while 2 * held <= width:
        out = np.minimum(out[:-held], out[held:])
        held *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - held : width - held + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and 40-bit hash of the anchor of each window; the leftmost of equals."""
    places, hashes = [], []
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        block = data[at : at + BLOCK + LENGTH - 1]
        grams = _gram_hashes(block)
        marked = (grams & ~INDEX) | np.arange(len(grams), dtype=np.uint64)
        lowest = _lowest(marked, WINDOW)
        places.append((lowest & INDEX).astype(np.int64) + at)
        hashes.append((lowest >> np.uint64(24)).astype(np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(hashes)


class Segments:
    """Runs of windows with one anchor, in texts laid end to end."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(size) - size
        place, hashed = anchors(self.data)
        inside = np.ones(len(place), bool)
        for end in (self.start + size).tolist():
            inside[max(0, end - LENGTH + 1) : end] = False
        window = np.flatnonzero(inside)
        place = place[window]
        # A new run begins where the anchor changes or windows are left out.
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        self.begin = window[first] if len(window) else window
        self.end = (window[last] if len(window) else window) + LENGTH
        self.anchor = place[first]
        self.hash = hashed[window[first]]
        self.text = np.searchsorted(self.start, self.begin, side="right") - 1
        # Empty texts share a start with the next one, which is the later of them.

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("begin", "end", "anchor", "hash", "text"):
            setattr(self, name, getattr(self, name)[chosen])


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(text.encode())
        size += len(held[-1])
        if size >= PIECE_BYTES:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


class Slot:
    """The documents of a slot in a fixed order, those without an id last."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids = self.table.column("doc_id")
        self.ids = ids.drop_null().to_numpy()
        self.texts = self.table.column("text").slice(0, len(self.ids)).to_pylist()

        # Number of the first document, and the segments, of each piece of the slot.
        self.pieces = [(at, Segments(texts)) for at, texts in _pieces(self.texts)]

    def anchors(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Distinct hashes, in order, that one document has; and those that several have.

        Each with its numbers of occurrences.
        """
        hashes, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, found in self.pieces:
            hashes.append(found.hash)
            docs.append(self.ids[at + found.text])
        hashed, doc = np.concatenate(hashes), np.concatenate(docs)
        order = np.argsort(hashed, kind="stable")
        hashed, doc = hashed[order], doc[order]
        if not len(hashed):
            return (hashed, hashed), (hashed, hashed)
        first = np.flatnonzero(np.append(True, hashed[1:] != hashed[:-1]))
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        hashed, count = hashed[first], np.diff(np.append(first, len(hashed)))
        return (hashed[~several], count[~several]), (hashed[several], count[several])

    def shared(self, masks: dict[int, tuple], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes that several documents have, by the buckets' answers; and the hot among them."""
        (alone, _), (several, _) = self.anchors()
        kept, hot = [several], [several[:0]]
        for b, (mask, hot_alone, hot_several) in masks.items():
            mine, others = alone[alone % buckets == b], several[several % buckets == b]
            for chosen, of, bits in ((kept, mine, mask), (hot, mine, hot_alone), (hot, others, hot_several)):
                chosen.append(of[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(of)) > 0])
        shared, hot = np.unique(np.concatenate(kept)), np.unique(np.concatenate(hot))
        return shared, hot[_among(hot, shared)]

    def occurrences(self, shared: np.ndarray) -> Iterator[tuple[int, int, bytes, int]]:
        """Document number, place, bytes and anchor of every segment with a shared anchor."""
        for at, found in self.pieces:
            found.keep(_among(found.hash, shared))
            data = found.data.tobytes()
            place = found.begin - found.start[found.text]
            yield from zip(
                (at + found.text).tolist(),
                place.tolist(),
                [data[a:b] for a, b in zip(found.begin.tolist(), found.end.tolist(), strict=True)],
                found.hash.tolist(),
                strict=True,
            )


class Windows:
    """The distinct windows at the hot anchors of a slot, in a fixed order by bucket."""

    def __init__(self, slot: Slot, hot: np.ndarray, buckets: int):
        keys, documents, places = [], [], []
        for at, found in slot.pieces if len(hot) else ():
            chosen = np.flatnonzero(_among(found.hash, hot))
            if not len(chosen):
                continue
            count = found.end[chosen] - found.begin[chosen] - LENGTH + 1
            text = np.repeat(found.text[chosen], count)
            start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            start += np.repeat(found.begin[chosen], count)
            keys.append(
                np.stack([_gram_hashes(found.data, LENGTH, seed)[start] for seed in (3, 977)], axis=1)
            )
            documents.append(at + text)
            places.append(start - found.start[text])
        #: Document number and place of every occurrence, and the number of its window.
        self.document = np.concatenate([*documents, np.zeros(0, np.int64)])
        self.place = np.concatenate([*places, np.zeros(0, np.int64)])
        every = np.concatenate([*keys, np.zeros((0, 2), np.uint64)])
        bucket = (every[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((every[:, 1], every[:, 0], bucket))
        every, bucket = every[order], bucket[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.window = np.zeros(len(every), np.int64)
        self.window[order] = np.cumsum(new) - 1
        self.keys, self.bucket = every[first], bucket[first]
        ids = slot.ids[self.document[order]]
        self.least = np.minimum.reduceat(ids, first) if len(first) else ids

    def sent(self, slot: int) -> list[tuple]:
        """Rows of the windows' hashes and least documents, one for each bucket."""
        if not len(self.bucket):
            return []
        first = np.flatnonzero(np.append(True, self.bucket[1:] != self.bucket[:-1]))
        return [
            (slot, int(self.bucket[a]), WINDOWS, self.keys[a:b].tobytes(), b"", self.least[a:b].tobytes())
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(self.bucket)], strict=True)
        ]

    def removed(self, ids: np.ndarray, answers: pa.Table) -> Iterator[tuple[int, int]]:
        """Document number and place of every window that a smaller doc_id has, too."""
        smaller = np.zeros(len(self.keys), bool)
        for b, (mask,) in _answers(answers, SMALLER, "data").items():
            low, high = np.searchsorted(self.bucket, [b, b + 1])
            smaller[low:high] = np.unpackbits(np.frombuffer(mask, np.uint8), count=high - low) > 0
        gone = smaller[self.window] | (ids[self.document] > self.least[self.window])
        yield from zip(self.document[gone].tolist(), self.place[gone].tolist(), strict=True)


def _smaller(table: pa.Table) -> list[tuple]:
    """For every slot that sent windows to a bucket, which of them a smaller doc_id has."""
    sent = [
        (slot, bucket, np.frombuffer(data, np.uint64).reshape(-1, 2), np.frombuffer(ids, np.int64))
        for slot, bucket, data, ids in zip(
            *(table.column(c).to_pylist() for c in ("slot", "bucket", "data", "ids")), strict=True
        )
    ]
    if not sent:
        return []
    keys, ids = (np.concatenate([x[k] for x in sent]) for k in (2, 3))
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    smaller = np.zeros(len(ids), bool)
    smaller[order] = least[np.cumsum(new) - 1] < ids[order]
    parts = np.split(smaller, np.cumsum([len(x[3]) for x in sent])[:-1])
    return [
        (slot, bucket, SMALLER, np.packbits(mask).tobytes(), b"", b"")
        for (slot, bucket, _, _), mask in zip(sent, parts, strict=True)
        if mask.any()
    ]


PACKED = "slot int, bucket int, kind int, data binary, more binary, ids binary"
ALONE, MASK, CONTENT, SPANS, WINDOWS, SMALLER = range(6)


def _packed(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    return pa.table(
        {
            name.split()[0]: pa.array(column, kind)
            for name, column, kind in zip(PACKED.split(", "), columns, kinds, strict=True)
        }
    )


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _by_bucket(hashed: np.ndarray, count: np.ndarray, buckets: int) -> dict[int, tuple]:
    bucket = hashed % buckets
    order = np.argsort(bucket, kind="stable")
    within = (hashed[order] // buckets).astype(np.uint32)
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    count = count[order].astype(np.uint32)
    return {
        b: (within[edges[b] : edges[b + 1]].tobytes(), count[edges[b] : edges[b + 1]].tobytes())
        for b in np.flatnonzero(np.diff(edges)).tolist()
    }


def _shared_anchors(slots: DataFrame, buckets: int) -> DataFrame:
    """For every slot and bucket, masks of the slot's own hashes: that others have, and hot ones.

    The second mask is of the hashes that one document of the slot has, the third
    of those that several have.
    """

    def send(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        alone, several = (_by_bucket(*h, buckets) for h in Slot(table).anchors())
        none = (b"", b"")
        return _packed(
            [
                (slot, b, ALONE, one[0], more[0], one[1] + more[1])
                for b in sorted(alone.keys() | several.keys())
                for one, more in [(alone.get(b, none), several.get(b, none))]
            ]
        )

    def settle(table: pa.Table) -> pa.Table:
        slot, bucket = table.column("slot").to_pylist(), table.column("bucket")[0].as_py()
        mine = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
        several = [np.frombuffer(x, np.uint32) for x in table.column("more").to_pylist()]
        everyone = np.sort(np.concatenate(mine))
        twice = everyone[1:][everyone[1:] == everyone[:-1]]
        known = np.unique(np.concatenate([twice, *several]))
        counts = [np.frombuffer(x, np.uint32) for x in table.column("ids").to_pylist()]
        every = np.concatenate([x for pair in zip(mine, several, strict=True) for x in pair])
        order = np.argsort(every, kind="stable")
        every, count = every[order], np.concatenate(counts)[order].astype(np.int64)
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        hot = every[first[np.add.reduceat(count, first) > HOT]]
        rows = []
        for s, alone, more in zip(slot, mine, several, strict=True):
            masks = (_among(alone, known), _among(alone, hot), _among(more, hot))
            if any(mask.any() for mask in masks):
                rows.append((s, bucket, MASK, *(np.packbits(mask).tobytes() for mask in masks)))
        return _packed(rows)

    return (
        slots.groupBy("slot")
        .applyInArrow(send, PACKED)
        .groupBy("bucket")
        .applyInArrow(settle, PACKED)
    )


def _answers(table: pa.Table, kind: int, *columns: str) -> dict[int, tuple]:
    """By bucket, the columns of the rows of a kind."""
    return {
        b: tuple(values)
        for b, k, *values in zip(
            *(table.column(c).to_pylist() for c in ("bucket", "kind", *columns)), strict=True
        )
        if k == kind
    }


def _masks(table: pa.Table) -> dict[int, tuple]:
    return _answers(table, MASK, "data", "more", "ids")


def _owned(
    slot: Slot, shared: np.ndarray, buckets: int
) -> tuple[dict[bytes, list], list[tuple[int, int, bytes]]]:
    """Distinct segments, each with bucket and smallest doc_id; and all occurrences.

    The order of the segments is fixed, so that answers can name them by number.
    """
    held: dict[bytes, list] = {}
    places = []
    ids = slot.ids.tolist()
    for document, place, content, hashed in slot.occurrences(shared):
        seen = held.get(content)
        if seen is None:
            held[content] = [hashed % buckets, ids[document]]
        elif ids[document] < seen[1]:
            seen[1] = ids[document]
        places.append((document, place, content))
    return held, places


class SuffixTree:
    """Common-prefix intervals of ``LENGTH`` bytes and more over distinct segments.

    A segment stands for the documents that hold it: the least of them, and
    whether there are several.
    """

    def __init__(self, contents: list[bytes], least: np.ndarray, several: np.ndarray):
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(contents) + bytes(LONGEST), np.uint8)
        count = size - LENGTH + 1
        segment = np.repeat(np.arange(len(contents)), count)
        offset = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        left = size[segment] - offset
        # What follows a segment's end is blank; the length makes suffixes with blanks differ.
        rows = np.zeros((len(segment), LONGEST + 1), np.uint8)
        views = np.lib.stride_tricks.sliding_window_view(data, LONGEST)
        places = begin[segment] + offset
        for at in range(0, len(rows), ROWS):
            some = slice(at, at + ROWS)
            inside = np.arange(LONGEST) < left[some, None]
            rows[some, :LONGEST] = views[places[some]] * inside
        rows[:, LONGEST] = left
        order = np.argsort(rows.view(f"S{LONGEST + 1}").ravel(), kind="stable")
        left = left[order]
        same = np.full(max(0, len(rows) - 1), LONGEST)
        for at in range(0, len(same), ROWS):
            some = rows[order[at : at + ROWS + 1], :LONGEST]
            differs = some[1:] != some[:-1]
            same[at : at + len(differs)] = np.where(
                differs.any(axis=1), differs.argmax(axis=1), LONGEST
            )
        self.common = np.minimum(same, np.minimum(left[1:], left[:-1]))
        self.segment, self.offset, self.size = segment[order], offset[order], size
        self.least, self.several = least, several
        # The byte on the left; at a segment's first byte it is unknown.
        before = data[begin[self.segment] + self.offset - 1].astype(np.int64)
        self.left = np.where(self.offset > 0, before, -1)

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last suffix and depth of every interval, by a stack scan."""
        found: list[tuple[int, int, int]] = []
        stack: list[tuple[int, int]] = []
        deep = np.flatnonzero(self.common >= LENGTH)
        previous = -2
        for i, depth in zip(deep.tolist(), self.common[deep].tolist(), strict=True):
            if i != previous + 1:
                while stack:
                    high, first = stack.pop()
                    found.append((first, previous + 1, high))
            first = i
            while stack and stack[-1][0] > depth:
                high, first = stack.pop()
                found.append((first, i, high))
            if not stack or stack[-1][0] < depth:
                stack.append((depth, first))
            previous = i
        while stack:
            high, first = stack.pop()
            found.append((first, previous + 1, high))
        first, last, depth = np.array(found, np.int64).reshape(-1, 3).T
        return first, last, depth

    def maximal(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals with more than one left neighbour.

        A segment that several documents hold is one by itself, from its first byte.
        """
        first, last, depth = self.intervals()
        if len(self.left):
            changes = np.cumsum(
                np.append(0, (self.left[1:] != self.left[:-1]) | (self.left[1:] < 0))
            )
            diverse = (changes[last] > changes[first]) | (self.left[first] < 0)
            first, last, depth = first[diverse], last[diverse], depth[diverse]
        whole = np.flatnonzero((self.offset == 0) & self.several[self.segment])
        return (
            np.concatenate([first, whole]),
            np.concatenate([last, whole]),
            np.concatenate([depth, self.size[self.segment[whole]]]),
        )

    def members(self) -> tuple[np.ndarray, ...]:
        """Group, segment, offset, depth and the group's least document, of all members."""
        first, last, depth = self.maximal()
        if not len(first):
            return (first,) * 5
        size = last - first + 1
        group = np.repeat(np.arange(len(size)), size)
        member = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + first[group]
        held = np.append(self.least[self.segment], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(held, np.stack([first, last + 1], axis=1).ravel())[::2]
        return group, self.segment[member], self.offset[member], depth[group], least[group]


class Bucket:
    """The segments that slots have sent to a bucket."""

    def __init__(self, table: pa.Table):
        self.bucket = table.column("bucket")[0].as_py()
        self.slots = []  # slot, numbers of its segments here, their least documents
        held: dict[bytes, int] = {}
        least: list[int] = []
        several: list[bool] = []
        for slot, data, sizes, ids in zip(
            *(table.column(c).to_pylist() for c in ("slot", "data", "more", "ids")), strict=True
        ):
            end, numbers = 0, []
            for size, doc in zip(
                np.frombuffer(sizes, np.uint8).tolist(), np.frombuffer(ids, np.int64).tolist(),
                strict=True,
            ):
                content = data[end : end + size]
                end += size
                number = held.setdefault(content, len(held))
                if number == len(least):
                    least.append(doc)
                    several.append(False)
                elif doc != least[number]:
                    several[number] = True
                    least[number] = min(doc, least[number])
                numbers.append(number)
            self.slots.append((slot, np.array(numbers), np.frombuffer(ids, np.int64)))
        self.tree = SuffixTree(list(held), np.array(least, np.int64), np.array(several, bool))


def _sent_segments(
    slots: DataFrame, masks: DataFrame, buckets: int, spread: int, part: bool = False
) -> DataFrame:
    """Distinct segments, to their anchors' buckets; if ``part``, windows at hot anchors."""

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _packed([])
        slot = Slot(table)
        shared, hot = slot.shared(_masks(answers), buckets)
        windows = []
        number = table.column("slot")[0].as_py()
        if part:
            shared = shared[~_among(shared, hot)]
            windows = Windows(slot, hot, spread).sent(number)
        held, _ = _owned(slot, shared, spread)
        grouped: dict[int, list[tuple[bytes, int]]] = {}
        for content, (bucket, doc) in held.items():
            grouped.setdefault(bucket, []).append((content, doc))
        return _packed(
            [
                (
                    number,
                    bucket,
                    CONTENT,
                    b"".join(c for c, _ in some),
                    bytes(len(c) for c, _ in some),
                    np.array([d for _, d in some], np.int64).tobytes(),
                )
                for bucket, some in grouped.items()
            ]
            + windows
        )

    return slots.groupBy("slot").cogroup(masks.groupBy("slot")).applyInArrow(send, PACKED)


def _own_spans(table: pa.Table) -> pa.Table:
    """For every slot, spans of its own segments that a smaller doc_id has, too."""
    kind = table.column("kind").to_numpy()
    rows = _smaller(table.filter(pa.array(kind == WINDOWS)))
    table = table.filter(pa.array(kind == CONTENT))
    if not table.num_rows:
        return _packed(rows)
    bucket = Bucket(table)
    _, segment, begin, depth, least = bucket.tree.members()
    order = np.lexsort((least, segment))
    segment, begin, least = segment[order], begin[order], least[order]
    end = begin + depth[order]
    if len(segment):
        # Spans of over half a segment overlap, so those of one least document are one span.
        at = np.flatnonzero(
            np.append(True, (segment[1:] != segment[:-1]) | (least[1:] != least[:-1]))
        )
        begin, end = np.minimum.reduceat(begin, at), np.maximum.reduceat(end, at)
        segment, least = segment[at], least[at]
    for slot, numbers, docs in bucket.slots:
        low = np.searchsorted(segment, numbers, "left")
        count = np.searchsorted(segment, numbers, "right") - low
        own = np.repeat(np.arange(len(numbers)), count)
        span = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]
        useful = least[span] < docs[own]
        own, span = own[useful], span[useful]
        if len(own):
            ends = np.stack([begin[span], end[span]], axis=1).astype(np.uint8)
            rows.append(
                (slot, bucket.bucket, SPANS, own.astype(np.uint32).tobytes(), ends.tobytes(), b"")
            )
    return _packed(rows)


def _setting(documents: DataFrame, *others: str) -> tuple[DataFrame, int, int]:
    """Documents in slots, and the numbers of buckets of anchors and of segments."""
    docs = texts_of(documents, *others)
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    slots = max(8, -(-size // SLOT_BYTES))
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int")
    return (
        docs.withColumn("slot", slot),
        max(8, -(-size // ANCHOR_BYTES)),
        max(8, -(-size // SEGMENT_BYTES)),
    )


def maximal_repeats(documents: DataFrame) -> DataFrame:
    """All maximal repeats of ``LENGTH`` bytes and more that two documents share.

    ``repeat`` (a group's name), ``length``, ``doc_id`` and ``place`` (in bytes)
    of every occurrence. Repeats are maximal within the windows of one anchor: a
    longer common passage comes as overlapping groups that cover it, each with
    all its occurrences. All segments of an anchor meet in one bucket here, hot or not. Texts are UTF-8, null ones empty; rows with a null id
    take no part.
    """
    slots, buckets, spread = _setting(documents.where(F.col("doc_id").isNotNull()))
    masks = _shared_anchors(slots, buckets)

    def grouped(table: pa.Table) -> pa.Table:
        bucket = Bucket(table)
        group, segment, offset, depth, _ = bucket.tree.members()
        order = np.argsort(segment, kind="stable")
        group, segment, offset, depth = (x[order] for x in (group, segment, offset, depth))
        rows = []
        for slot, numbers, _ in bucket.slots:
            low = np.searchsorted(segment, numbers, "left")
            count = np.searchsorted(segment, numbers, "right") - low
            own = np.repeat(np.arange(len(numbers)), count)
            at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]
            if len(own):
                ends = np.stack([offset[at], depth[at]], axis=1).astype(np.uint8)
                rows.append(
                    (
                        slot,
                        bucket.bucket,
                        SPANS,
                        own.astype(np.uint32).tobytes(),
                        ends.tobytes(),
                        group[at].astype(np.int64).tobytes(),
                    )
                )
        return _packed(rows)

    groups = (
        _sent_segments(slots, masks, buckets, spread).groupBy("bucket").applyInArrow(grouped, PACKED)
    )

    def places(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: set[tuple] = set()
        if table.num_rows:
            slot = Slot(table)
            held, found = _owned(slot, slot.shared(_masks(answers), buckets)[0], spread)
            members = _answered(held, answers)
            for document, place, content in found:
                for group, offset, depth in members.get(content, ()):
                    out.add((group, depth, int(slot.ids[document]), place + offset))
        columns = list(zip(*sorted(out), strict=True)) or [()] * 4
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.table(
            {
                name: pa.array(column, kind)
                for name, column, kind in zip(
                    ("repeat", "length", "doc_id", "place"), columns, kinds, strict=True
                )
            }
        )

    return (
        slots.groupBy("slot")
        .cogroup(masks.unionByName(groups).groupBy("slot"))
        .applyInArrow(places, "repeat string, length int, doc_id long, place long")
    )


def _answered(held: dict[bytes, list], answers: pa.Table) -> dict[bytes, list]:
    """What the buckets have answered for a slot's segments: name, first and second number."""
    grouped: dict[int, list[bytes]] = {}
    for content, (bucket, _) in held.items():
        grouped.setdefault(bucket, []).append(content)
    out: dict[bytes, list] = {}
    for b, (own, ends, names) in _answers(answers, SPANS, "data", "more", "ids").items():
        own = np.frombuffer(own, np.uint32)
        named = np.frombuffer(names, np.int64) if names else np.zeros(len(own), np.int64)
        for k, (x, y), name in zip(
            own.tolist(), np.frombuffer(ends, np.uint8).reshape(-1, 2).tolist(), named.tolist(),
            strict=True,
        ):
            out.setdefault(grouped[b][k], []).append((f"{b}-{name}", x, y))
    return out


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union; spans that touch are one run."""
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


#: Rows of one id and text up to which a slot takes them as they are.
MANY = 1_000
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def without_repeats(documents: DataFrame, *others: str) -> DataFrame:
    """Every document without the bytes that stand in a smaller doc_id, too.

    A byte goes if a ``LENGTH``-byte string over it also starts in a document
    with a smaller doc_id, judged on the input. Columns: those of ``KEPT`` and
    the ``others`` as they are; ``kept`` is the text of the bytes that stay,
    without those of characters that were cut in part. Null texts are empty.
    Rows with a null id are smaller than none and keep all. Rows with one id
    never remove from each other. An empty table gives an empty result.

    Rows of one id and text have one result. One row stands for them all where
    there are more than ``MANY``, so that no slot has to hold them.
    """
    docs = texts_of(documents, *others)
    same = fresh(docs, "same")
    docs = docs.withColumn(
        same, F.struct("doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"))
    )
    many = docs.groupBy(same).agg(F.count("*").alias("rows")).where(F.col("rows") > MANY).select(same)
    number = many.count()
    if not number:
        return _cut(docs.drop(same), *others)
    scratch = Scratch(documents.sparkSession, "repeats")
    many = broadcast_within(scratch.stage(many, "many"), number)
    copies = docs.join(many, same, "left_semi").withColumn(same, F.to_json(same))
    one = copies.groupBy(same).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    rest = docs.join(many, same, "left_anti").withColumn(same, F.lit(None).cast("string"))
    each = rest.unionByName(one, allowMissingColumns=True)
    cut = scratch.stage(_cut(each, *others, same), "cut")
    stood = broadcast_within(cut.where(F.col(same).isNotNull()).drop(*others), number)
    return cut.where(F.col(same).isNull()).drop(same).unionByName(
        copies.select(same, *others).join(stood, same).drop(same)
    )


def _cut(documents: DataFrame, *others: str) -> DataFrame:
    """``without_repeats`` of documents none of which comes in very many rows."""
    slots, buckets, spread = _setting(documents, *others)
    masks = _shared_anchors(slots, buckets)
    spans = (
        _sent_segments(slots, masks, buckets, spread, part=True)
        .groupBy("bucket")
        .applyInArrow(_own_spans, PACKED)
    )

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        slot = Slot(table)
        removed: list[list] = [[] for _ in range(table.num_rows)]
        if table.num_rows:
            shared, hot = slot.shared(_masks(answers), buckets)
            windows = Windows(slot, hot, spread)
            for document, place in windows.removed(slot.ids, answers):
                if removed[document] and removed[document][-1][1] == place + LENGTH - 1:
                    removed[document][-1] = (removed[document][-1][0], place + LENGTH)
                else:
                    removed[document].append((place, place + LENGTH))
            held, found = _owned(slot, shared[~_among(shared, hot)], spread)
            own = _answered(held, answers)
            ids = slot.ids.tolist()
            for document, place, content in found:
                if ids[document] > held[content][1]:
                    removed[document].append((place, place + len(content)))
                else:
                    removed[document] += [
                        (place + a, place + b) for _, a, b in own.get(content, ())
                    ]
        out = []
        for doc_id, text, spans in zip(
            slot.table.column("doc_id").to_pylist(),
            slot.table.column("text").to_pylist(),
            removed,
            strict=True,
        ):
            data = text.encode()
            runs = _runs(spans)
            edges = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append(
                (
                    doc_id,
                    len(data),
                    len(data) - len(kept),
                    len(runs),
                    hashlib.sha256(kept).hexdigest(),
                    kept.decode("utf-8", "ignore"),
                )
            )
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * 6
        made = {
            name.split()[0]: pa.array(column, kind)
            for name, column, kind in zip(KEPT.split(", "), columns, kinds, strict=True)
        }
        return pa.table(made | {name: slot.table.column(name) for name in others})

    passed = (f", {f.name} {f.dataType.simpleString()}" for f in slots.schema if f.name in others)
    return (
        slots.groupBy("slot")
        .cogroup(masks.unionByName(spans).groupBy("slot"))
        .applyInArrow(cut, KEPT + "".join(passed))
    )


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
