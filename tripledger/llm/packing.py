"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of the full sequence length and one shorter
rest. The rests are the items of a cutting-stock problem: their lengths, in
classes of ``UNIT`` tokens, are the demands; a pattern says how many items of
each class share a sequence. A linear program over patterns is solved by column
generation: a knapsack dynamic program prices new patterns with the duals. The
pattern counts are rounded down, and the ranked documents of each class take the
patterns' slots by arithmetic on their ranks: no document is looked up, moved or
compared with another.

What rounding leaves over is cut to fill the gaps that the patterns leave, then
laid end to end; its last, partial sequence is split into powers of two. So no
token is padding, and only the share of documents that the gaps need is cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.llm.common import map_batches, read_table, texts_of
from tripledger.llm.encoding import encoder
from tripledger.session import Scratch, bounded_batches

TOKENIZER = "word_bpe_49k.json"
END = 1
SEQUENCE = 2048
UNIT = 8
#: The linear program stops here, or sooner when no more than half a sequence can be won.
MAX_PATTERNS = 3000
#: Left-over documents that may be broadcast, about 100 bytes each; beyond that they are joined.
BROADCAST_ROWS = 200_000
FAR = 1 << 40


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of items that fits, by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    size_up, value_up = size[order], value[order]
    fits = np.searchsorted(size_up, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            worth = best[room - size_up[:n]] + value_up[:n]
            k = int(np.argmax(worth))
            if worth[k] > best[room] + 1e-12:
                best[room], choice[room] = worth[k], k
    taken, room = np.zeros(len(size), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        taken[order[choice[room]]] += 1
        room -= size_up[choice[room]]
    return float(best[capacity]), taken


def patterns_for(
    size: np.ndarray, demand: np.ndarray, capacity: int, most: int = MAX_PATTERNS
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and their fractional counts in an optimal basis."""
    basis = np.diag((capacity // size).astype(float))
    count = demand / np.diag(basis)
    for _ in range(most):
        price = np.linalg.solve(basis.T, np.ones(len(size)))
        best, column = knapsack(price, size, capacity)
        # No solution has fewer than sum / best sequences.
        if best <= 1 + 1e-9 or count.sum() * (1 - 1 / best) < 0.5:
            break
        step = np.linalg.solve(basis, column.astype(float))
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(len(size), np.inf)
        ratio[up] = np.maximum(count[up], 0) / step[up]
        leaving = int(np.argmin(ratio))
        count = count - step * ratio[leaving]
        count[leaving] = ratio[leaving]
        basis[:, leaving] = column
    return basis.astype(np.int64), np.maximum(count, 0)


@dataclass
class Layout:
    """Where ranked items go; its size depends on the sequence length alone."""

    first: np.ndarray  # rank in its class of the first item of each length
    slots: np.ndarray  # of each class
    block_key: np.ndarray  # class and first rank of each block of slots
    block_class: np.ndarray
    block_rank: np.ndarray
    block_sequence: np.ndarray
    before: list[list[int]]  # blocks that precede a block in its sequences
    length_key: np.ndarray  # class and first rank of each length
    lengths: np.ndarray
    rest_start: np.ndarray  # place of each length's first left-over token
    cell_start: np.ndarray  # runs of equal gaps, then of equal sequences
    cell_width: np.ndarray
    cell_sequence: np.ndarray
    cell_offset: np.ndarray
    sequences: int
    left_over: int

    def length_at(self, kind: int, rank: np.ndarray) -> np.ndarray:
        return self.lengths[np.searchsorted(self.length_key, kind * FAR + rank, "right") - 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sequence and offset of items by length and rank in it; -1 for what is left over.

        Third, the place of a left-over item among all left-over tokens.
        """
        kind = -(-length // UNIT)
        inside = self.first[length] + rank
        slotted = inside < self.slots[kind]
        block = np.searchsorted(self.block_key, kind * FAR + inside, "right") - 1
        sequence, offset = np.full(len(length), -1), np.full(len(length), -1)
        for b in np.unique(block[slotted]):
            at = np.flatnonzero(slotted & (block == b))
            copy = inside[at] - self.block_rank[b]
            sequence[at] = self.block_sequence[b] + copy
            offset[at] = sum(
                (
                    self.length_at(self.block_class[p], self.block_rank[p] + copy)
                    for p in self.before[b]
                ),
                np.zeros(len(at), np.int64),
            )
        nth = inside - np.maximum(self.first[length], self.slots[kind])
        return sequence, offset, self.rest_start[length] + nth * length

    def cut(self, place: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """Start in the item, length, sequence and offset of the parts of a left-over item."""
        start = 0
        while start < length:
            at = place + start
            cell = int(np.searchsorted(self.cell_start, at, "right")) - 1
            nth, inside = divmod(at - int(self.cell_start[cell]), int(self.cell_width[cell]))
            part = min(length - start, int(self.cell_width[cell]) - inside)
            yield start, part, int(self.cell_sequence[cell]) + nth, int(
                self.cell_offset[cell]
            ) + inside
            start += part


def layout(histogram: np.ndarray, sequence: int = SEQUENCE) -> Layout:
    """``histogram[n]``: the number of items of ``n`` tokens, for n below ``sequence``."""
    length = np.arange(sequence)
    kind = -(-length // UNIT)
    capacity = sequence // UNIT
    before = np.cumsum(histogram) - histogram
    class_start = np.searchsorted(kind, np.arange(capacity + 1))
    first = before - before[np.minimum(class_start, sequence - 1)][kind]
    demand = np.bincount(kind, histogram, capacity + 1).astype(np.int64)
    size = np.flatnonzero(demand)
    if len(size):
        columns, exact = patterns_for(size, demand[size].astype(float), capacity)
    else:
        columns, exact = np.zeros((0, 0), np.int64), np.zeros(0)
    there = np.flatnonzero(histogram)
    length_key = kind[there] * FAR + first[there]
    spare = 0.0
    while True:
        made = _blocks(size, columns, np.floor(exact * (1 - spare) + 1e-9).astype(np.int64))
        slots = np.zeros(capacity + 1, np.int64)
        for c, _, _, n, _ in made[0]:
            slots[c] += n
        gaps = list(_gaps(made, length_key, there, sequence))
        rest = np.clip(first + histogram - np.maximum(first, slots[kind]), 0, histogram)
        if sum(n * g for _, n, g in gaps) <= (rest * length).sum():
            break
        spare = min(1.0, 2 * spare + 0.001)
    blocks, sequences = made
    key = np.array([c * FAR + r for c, r, _, _, _ in blocks], np.int64)
    order = np.argsort(key)
    renamed = np.argsort(order)
    cells, at = [], 0
    for start, n, gap in gaps:
        cells.append((at, gap, start, sequence - gap))
        at += n * gap
    # The rest of the rest: whole sequences, then powers of two.
    tail = int((rest * length).sum()) - at
    width, used = sequence, sequences
    while tail:
        n, tail = divmod(tail, width)
        if n:
            cells.append((at, width, used, 0))
            at, used = at + n * width, used + n
        width = 1 << max(0, tail.bit_length() - 1)
    cells = np.array(cells or [(0, sequence, used, 0)], np.int64)
    return Layout(
        first,
        slots,
        key[order],
        np.array([b[0] for b in blocks], np.int64)[order],
        np.array([b[1] for b in blocks], np.int64)[order],
        np.array([b[2] for b in blocks], np.int64)[order],
        [[int(renamed[p]) for p in blocks[k][4]] for k in order],
        length_key,
        there,
        np.cumsum(rest * length) - rest * length,
        *cells.T,
        used,
        int(rest.sum()),
    )


def _blocks(size: np.ndarray, columns: np.ndarray, count: np.ndarray):
    """Blocks of slots, one for each item of each pattern, and the number of sequences.

    A block: class, first rank, first sequence, number of copies, blocks before it.
    """
    taken: dict[int, int] = {}
    blocks, at = [], 0
    for column, n in zip(columns.T, count.tolist(), strict=True):
        if not n:
            continue
        opened = len(blocks)
        for c, items in zip(size.tolist(), column.tolist(), strict=True):
            for _ in range(items):
                blocks.append((c, taken.get(c, 0), at, n, list(range(opened, len(blocks)))))
                taken[c] = taken.get(c, 0) + n
        at += n
    return blocks, at


def _gaps(made, length_key: np.ndarray, lengths: np.ndarray, sequence: int):
    """Runs of consecutive sequences with equal gaps: first sequence, number, gap."""
    blocks, _ = made
    groups: dict[int, list] = {}
    for c, rank, start, n, _ in blocks:
        groups.setdefault(start, []).append((c, rank, n))
    for start, items in groups.items():
        n = items[0][2]
        edges = {0}
        for c, rank, _ in items:
            low = np.searchsorted(length_key, c * FAR + rank, "right")
            high = np.searchsorted(length_key, c * FAR + rank + n, "left")
            edges.update((length_key[low:high] - c * FAR - rank).tolist())
        edges = np.array(sorted(edges))
        filled = np.zeros(len(edges), np.int64)
        for c, rank, _ in items:
            filled += lengths[np.searchsorted(length_key, c * FAR + rank + edges, "right") - 1]
        for k, upto, full in zip(edges, [*edges[1:], n], filled, strict=True):
            if full < sequence:
                yield start + int(k), int(upto - k), int(sequence - full)


PIECES = (
    "part int, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "text_hash long"
)


def _ids_of(batch: pa.RecordBatch, tokenizer: str) -> Iterator[bytes]:
    for ids, starts in encoder(tokenizer).encode(batch.column("text"), END):
        raw = ids.tobytes()
        for a, b in zip((4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist(), strict=True):
            yield raw[a:b]


def _hashed(documents: DataFrame) -> DataFrame:
    return texts_of(documents).withColumn("text_hash", F.xxhash64("text"))


def pieces(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Full pieces and the rest of every document; ``nth`` counts a task's pieces of a length."""

    def run(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(SEQUENCE + 1, np.int64)
        for batch in batches:
            out = []
            ids_of = _ids_of(batch, tokenizer)
            keys = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
            for doc_id, text_hash, ids in zip(*keys, ids_of, strict=True):
                total = len(ids) // 4
                for start in range(0, total, SEQUENCE):
                    piece = ids[4 * start : 4 * (start + SEQUENCE)]
                    n = len(piece) // 4
                    out.append(
                        (part, int(seen[n]), doc_id, start, n, zlib.crc32(piece), total, text_hash)
                    )
                    seen[n] += 1
            if out:
                columns = [pa.array(c) for c in zip(*out, strict=True)]
                columns[0] = columns[0].cast(pa.int32())
                columns[2] = columns[2].cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    columns, [name.split()[0] for name in PIECES.split(", ")]
                )

    bounded_batches(documents.sparkSession)
    return _hashed(documents).mapInArrow(run, PIECES)


RESULT = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
PLACED = f"{RESULT}, text_hash long"
#: Left-over items of one text that are cut together lie within so many left-over tokens.
LEFT_TOGETHER = 1 << 20


def pack(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents; one row for each piece.

    A null or empty text is the end id alone; repeated rows are packed as often
    as they come; an empty table gives no row. ``tokenizer`` is a path.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.stage(pieces(documents, tokenizer), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(SEQUENCE + 1, np.int64)  # one row for each length
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    plan = layout(histogram[:SEQUENCE])
    shared = spark.sparkContext.broadcast(plan)
    prior = counts.select(
        "length",
        "part",
        (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("prior"),
    )
    ranked = cut.join(prior, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "text_hash",
        (F.col("prior") + F.col("nth")).alias("rank"),
    )

    def rows(batch: pa.RecordBatch):
        plan = shared.value
        n = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        full = n == SEQUENCE
        sequence, offset, place = plan.place(np.where(full, 1, n), rank)
        sequence = np.where(full, plan.sequences + rank, sequence)
        offset = np.where(full, 0, offset)
        # A left-over item keeps its place in the offset's column for now.
        offset = np.where(sequence < 0, place, offset)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(sequence), pa.array(offset), batch.column("text_hash")],
            [name.split()[0] for name in PLACED.split(", ")],
        )

    placed = map_batches(ranked, rows, PLACED)
    whole = placed.where("sequence_id >= 0").drop("text_hash")
    if not plan.left_over:
        return whole
    # Items of one text stay apart where there are many; an id alone brings none together.
    parts = (
        placed.where("sequence_id < 0")
        .groupBy("doc_id", "text_hash", F.shiftright("offset", LEFT_TOGETHER.bit_length() - 1))
        .agg(F.collect_list(F.struct("start", "length", "ids_crc32", "offset")).alias("items"))
        .select("doc_id", "text_hash", "items")
    )
    keys = parts.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    if plan.left_over <= BROADCAST_ROWS:
        parts, keys = F.broadcast(parts), F.broadcast(keys)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    # Only the texts that are cut once more are tokenized once more, repeated rows as one.
    again = (
        _hashed(documents)
        .join(keys, same, "left_semi")
        .dropDuplicates(["doc_id", "text"])
        .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "text")
        .join(parts, same)
        .select("doc_id", "text", "items")
    )

    def cut_rows(batch: pa.RecordBatch):
        plan, out = shared.value, []
        ids_of = _ids_of(batch, tokenizer)
        for doc_id, items, ids in zip(
            batch.column("doc_id").to_pylist(), batch.column("items").to_pylist(), ids_of,
            strict=True,
        ):
            total = len(ids) // 4
            start = total // SEQUENCE * SEQUENCE
            rest = ids[4 * start :]
            for item in items:
                # Should two texts of an id share a hash, items of the other are not this one's.
                if (item["start"], 4 * item["length"], item["ids_crc32"]) != (
                    start, len(rest), zlib.crc32(rest),
                ):
                    continue
                for at, n, sequence, offset in plan.cut(item["offset"], item["length"]):
                    part = rest[4 * at : 4 * (at + n)]
                    out.append(
                        (doc_id, start + at, n, zlib.crc32(part), total, sequence, offset)
                    )
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                columns, [name.split()[0] for name in RESULT.split(", ")]
            )

    # Texts of one id with equal tokens and hashes each cut all their items: a place counts once.
    parted = map_batches(again, cut_rows, RESULT).dropDuplicates(["sequence_id", "offset"])
    return whole.unionByName(parted)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
