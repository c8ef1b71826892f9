"""Token ids on disk: zstandard frames of single documents with a shared dictionary.

A set of files is three Parquet tables below one folder, so it can lie wherever
Spark writes and a lost task leaves nothing half written:

``dictionary``
    One row: the dictionary's bytes and their SHA-256. It is trained on the
    serialized ids of a bounded sample of short documents.
``blocks``
    Documents in ascending doc_id order. A block holds the frames of consecutive
    documents, one frame each, laid end to end; the offset index (doc_id, number
    of ids and first byte of every frame); the ids that precede it in its part;
    and the hash of the dictionary that its frames need.
``parts``
    The ids and documents that precede each part, a consecutive range of blocks.

One document is read by its block's id range and its frame's offset: neither its
neighbours' frames nor other blocks are decompressed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.common import broadcast_within, read_table, texts_of
from tripledger.llm.encoding import encoder
from tripledger.session import Scratch, scratch_path

TOKENIZER = "word_bpe_49k.json"
END = 1
LEVEL = 3
DICTIONARY_BYTES = 1 << 16
#: The dictionary is trained on about so many distinct texts, none longer than this.
SAMPLE_TEXTS = 2_000
SAMPLE_CHARACTERS = 8_192
#: A block is closed at so many bytes of frames, or so many documents.
BLOCK_BYTES = 1 << 20
BLOCK_DOCUMENTS = 4_096
#: Bytes of ids that go back to Spark at once.
BATCH_BYTES = 1 << 25

FRAMES = "doc_id long, n_tokens long, ids_crc32 long, place long, frame binary"
BLOCKS = (
    "part int, block int, before long, documents int, tokens long, first_id long, last_id long, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, width int, "
    "dictionary string, frames binary"
)
DECODED = "part int, doc_id long, before long, n_tokens long, ids binary"


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch; the types follow the schema's text."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(),
             "array<long>": pa.list_(pa.int64())}
    fields = [field.split() for field in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)],
        [name for name, _ in fields],
    )


def _ids_of(batch: pa.RecordBatch, tokenizer: str, end: int) -> Iterator[np.ndarray]:
    for ids, starts in encoder(tokenizer).encode(batch.column("text"), end):
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield ids[a:b]


def id_width(tokenizer: str, end: int) -> int:
    """Bytes of one id in a frame: two where every id of the vocabulary fits."""
    vocabulary = encoder(tokenizer).tokenizer.get_vocab(with_added_tokens=True)
    return 2 if max(max(vocabulary.values()), end) < 1 << 16 else 4


def train_dictionary(documents: DataFrame, tokenizer: str, end: int, width: int) -> bytes:
    """A dictionary for short documents, trained on serialized id arrays.

    The sample is every distinct text of 1 to ``SAMPLE_CHARACTERS`` characters
    whose hash falls below a rate that leaves about ``SAMPLE_TEXTS`` of them, so
    it is bounded whatever the ids and however often a text is repeated. Where
    there is too little to train on the dictionary is empty.
    """
    rows = documents.count()
    if not rows:
        return b""
    drawn = F.pmod(F.xxhash64("text", F.lit("dictionary")), F.lit(1 << 40))
    sample = (
        texts_of(documents)
        .where(F.length("text").between(1, SAMPLE_CHARACTERS))
        .where(drawn < int(min(1.0, SAMPLE_TEXTS / rows) * (1 << 40)))
        .select("text")
        .distinct()
    )

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = [ids.astype(f"<u{width}").tobytes() for ids in _ids_of(batch, tokenizer, end)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])

    samples = sorted(bytes(r["ids"]) for r in sample.mapInArrow(serialized, "ids binary").collect())
    if sum(map(len, samples)) < 16 * DICTIONARY_BYTES:
        size = sum(map(len, samples)) // 16
    else:
        size = DICTIONARY_BYTES
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short samples
        return b""


def _codec(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


def _frames(documents: DataFrame, tokenizer: str, end: int, width: int, shared) -> DataFrame:
    """Each document's ids in one frame; ``place`` names the row where ids repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(shared.value))
        place = TaskContext.get().partitionId() << 33
        for batch in batches:
            out, held = [], 0
            found = _ids_of(batch, tokenizer, end)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                frame = compressor.compress(ids.astype(f"<u{width}").tobytes())
                out.append((doc_id, len(ids), _crc32(ids), place, frame))
                place, held = place + 1, held + len(frame)
                if held >= BATCH_BYTES:
                    yield _arrow(out, FRAMES)
                    out, held = [], 0
            if out:
                yield _arrow(out, FRAMES)

    return texts_of(documents).mapInArrow(run, FRAMES)


def _crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _blocks(batches: Iterable[pa.RecordBatch], width: int, name: str) -> Iterator[pa.RecordBatch]:
    """The frames of one sorted part, gathered in blocks."""
    part = TaskContext.get().partitionId()
    ids: list = []
    tokens: list[int] = []
    frames: list[bytes] = []
    block, before, held = 0, 0, 0

    def closed() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
        known = [i for i in ids if i is not None]
        return _arrow(
            [(part, block, before, len(ids), sum(tokens), known[0] if known else None,
              known[-1] if known else None, ids, tokens, offsets, width, name, b"".join(frames))],
            BLOCKS,
        )

    for batch in batches:
        for doc_id, n, frame in zip(
            *(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True
        ):
            if ids and (held + len(frame) > BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS):
                yield closed()
                block, before, held = block + 1, before + sum(tokens), 0
                ids, tokens, frames = [], [], []
            ids.append(doc_id)
            tokens.append(n)
            frames.append(frame)
            held += len(frame)
    if ids:
        yield closed()


def write_ids(
    documents: DataFrame, path: str, tokenizer: str | None = None, end: int = END
) -> None:
    """Encode every document and write its ids, in ascending doc_id order.

    Null ids come first; documents of one id follow each other by the length and
    the checksum of their ids. A null text counts as empty and holds the end id
    alone; repeated rows are written as often as they come; other columns are
    not read. An empty table gives tables without rows, the dictionary's row
    excepted. Texts are encoded whole, a very long one in a block of its own.

    Texts are encoded once: their frames, a fraction of the text, are written
    before they are dealt out by ranges, so a hot id is spread over several
    ranges and the range bounds are drawn from what is already there.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    spark = documents.sparkSession
    width = id_width(tokenizer, end)
    content = train_dictionary(documents, tokenizer, end, width)
    name = hashlib.sha256(content).hexdigest()
    spark.createDataFrame([(name, bytearray(content))], "sha256 string, content binary").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(content)
    scratch = Scratch(spark, "frames")
    frames = scratch.stage(_frames(documents, tokenizer, end, width, shared), "frames")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "n_tokens", "ids_crc32", "place")]
    frames.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: _blocks(batches, width, name), BLOCKS
    ).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.release()
    sizes = (
        spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        .groupBy("part")
        .agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"))
        .orderBy("part")
        .collect()
    )
    rows, tokens, held = [], 0, 0
    for size in sizes:
        rows.append((size["part"], tokens, held))
        tokens, held = tokens + size["tokens"], held + size["documents"]
    spark.createDataFrame(rows, "part int, tokens long, documents long").coalesce(1).write.parquet(
        f"{path}/parts"
    )


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    name, content = row["sha256"], bytes(row["content"])
    if hashlib.sha256(content).hexdigest() != name:
        raise ValueError(f"the dictionary in {path} does not have the hash it is stored under")
    return name, content


def read_ids(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` of the documents in a set of files.

    ``ids`` are little-endian unsigned 32-bit numbers, ``start`` is the number
    of ids of all documents before. ``wanted`` is a condition on the blocks. A
    block that names another dictionary than the stored one is an error.
    """
    name, content = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(content)
    return _decoded(spark, path, name, shared, wanted, None)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of a few ids, as ``read_ids`` gives them; unknown ids give no row.

    Blocks are chosen by their id range, which their files state, and only the
    frames of these ids are decompressed.
    """
    name, content = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(content)
    near = F.lit(False)
    for doc_id in doc_ids:
        near = near | ((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    return _decoded(spark, path, name, shared, near, frozenset(doc_ids))


def _decoded(spark, path, name, shared, wanted: Column | None, only) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(dict_data=_codec(shared.value))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"a block needs the dictionary {row['dictionary']}")
                yield from _documents(row, decompressor, only)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if wanted is not None:
        blocks = blocks.where(wanted)
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("tokens").alias("prior"))
    found = blocks.select(
        "part", "before", "doc_ids", "n_tokens", "offsets", "width", "dictionary", "frames"
    ).mapInArrow(run, DECODED)
    return found.join(broadcast_within(parts, parts.count()), "part").select(
        "doc_id", (F.col("prior") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def _documents(row: dict, decompressor, only) -> Iterator[pa.RecordBatch]:
    frames, offsets = memoryview(row["frames"]), row["offsets"]
    before, out, held = row["before"], [], 0
    for k, (doc_id, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
        if only is None or doc_id in only:
            raw = decompressor.decompress(frames[offsets[k] : offsets[k + 1]])
            ids = np.frombuffer(raw, f"<u{row['width']}").astype("<u4").tobytes()
            out.append((row["part"], doc_id, before, n, ids))
            held += len(ids)
            if held >= BATCH_BYTES:
                yield _arrow(out, DECODED)
                out, held = [], 0
        before += n
    if out:
        yield _arrow(out, DECODED)


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, number of ids and checksum, from the files written."""
    path = scratch_path(spark, "token-ids")
    write_ids(read_table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
