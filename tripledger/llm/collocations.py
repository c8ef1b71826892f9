"""Phrase collocations by dynamic itemset counting.

The pieces of all texts are written once as shards of word numbers. Steps scan
one shard after the other, round and round. All lengths are counted in the same
scan: single words from the first step on, and a longer phrase from the step
after both its subphrases (all words but the last, all but the first) have been
counted often enough in the shards scanned so far. A phrase is counted for one
full cycle, so in each shard once; when a whole cycle has brought no new frequent
phrase, all counts are complete.

What a scan must know is which phrases are frequent. It gets a bit table of fixed
size with two bits for each, so nothing that is sent to the tasks grows with the
input. A phrase that the table lets in by mistake does no harm: counts are kept
by shard, hence each is either missing or right, and a sum over shards that
reaches the threshold proves a phrase frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.llm.common import pieces_of, read_table, texts_of
from tripledger.session import Scratch, short_lived_shuffles

LEAST = 100
LONGEST = 5
TOP = 2_000
UNKNOWN = "und"
#: The state of phrases under way is rewritten in each step, so its cost grows with the shards.
SHARDS = 2
#: Bytes of text in one row of a shard; a longer text has a row of its own.
PIECE = 1 << 21
#: Shards and state are read a few times only, so small files are worth more than fast ones.
PACKING = "zstd"
#: Bits of the table of frequent phrases: 8 MB.
BITS = 1 << 26

# What ends a piece; white space within a piece is a space or a tab.
ENDS = "[.,;:!?\n\x0b\x0c\r]+"
BREAK = "."

# Products pass 64 bits; these stay within 38 digits.
SCORE = (
    "(CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(16,0)) * 1000BD) "
    "DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
)
SHARD_ROWS = "shard int, lang string, words long, vocabulary array<string>, ids binary"
FOUND = "lang string, size int, phrase string, n long"
KNOWN = "lang string, size int, phrase string, n long, step int"
SLOTS = "slot int, mask long"


def _encoded(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of some texts and all words by number, -1 where a piece ends."""
    spaced = pc.replace_substring_regex(pc.ascii_lower(texts), ENDS, f" {BREAK} ")
    closed = pc.binary_join_element_wise(spaced, BREAK, " ")
    each = pc.ascii_split_whitespace(closed).flatten().dictionary_encode()
    words, ids = each.dictionary, each.indices.to_numpy(zero_copy_only=False)
    # White space before the first word parts off an empty one, which is none.
    is_word = pc.and_(pc.not_equal(words, ""), pc.not_equal(words, BREAK))
    is_break = pc.equal(words, BREAK).to_numpy(zero_copy_only=False)
    kept = is_word.to_numpy(zero_copy_only=False)
    number = np.where(kept, np.cumsum(kept) - 1, np.where(is_break, -1, -2)).astype(np.int32)
    ids = number[ids]
    return words.filter(is_word), ids[ids != -2]


def shards(documents: DataFrame, count: int = SHARDS) -> DataFrame:
    """Texts as rows of word numbers, dealt out to ``count`` shards.

    A row holds texts of one language. Rows go round the shards, beginning
    elsewhere in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = TaskContext.get().partitionId()
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang))
                size = pc.binary_length(texts).to_pylist()
                for a, b in pieces_of(size, PIECE, int):
                    words, ids = _encoded(texts.slice(a, b - a))
                    nth += 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([nth % count], pa.int32()),
                            pa.array([lang]),
                            pa.array([int((ids >= 0).sum())]),
                            pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                            pa.array([ids.tobytes()], pa.binary()),
                        ],
                        ["shard", "lang", "words", "vocabulary", "ids"],
                    )

    held = texts_of(documents, "lang").withColumn("lang", F.coalesce("lang", F.lit(UNKNOWN)))
    return held.mapInArrow(run, SHARD_ROWS)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    return _mixed(prefix * np.uint64(0xD6E8FEB86659FD93) + word)


def _word_hashes(words: list[str], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.fromiter(
        (xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)
    )


class Frequent:
    """A table of bits that holds the hashes of frequent phrases, each by two bits."""

    def __init__(self, bits: int = BITS):
        self.words = np.zeros(bits // 64, np.uint64)

    def __getstate__(self) -> tuple:
        """Few bits travel as the words that have any, many as the whole table."""
        there = np.flatnonzero(self.words)
        if 12 * len(there) < 8 * len(self.words):
            return len(self.words), there.astype(np.int32), self.words[there]
        return len(self.words), None, self.words

    def __setstate__(self, state: tuple) -> None:
        size, there, words = state
        self.words = words
        if there is not None:
            self.words = np.zeros(size, np.uint64)
            self.words[there] = words

    def places(self, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Word and bit of both places of each hash."""
        size = np.uint64(64 * len(self.words))
        both = (h % size, (h >> np.uint64(32)) % size)
        return [(p >> np.uint64(6), p & np.uint64(63)) for p in both]

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for word, bit in self.places(h):
            found &= (self.words[word] >> bit & np.uint64(1)).astype(bool)
        return found


def _slots(frequent: DataFrame, bits: int) -> DataFrame:
    """The bits of phrases, one row for each word of the table that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Frequent(bits)
        for batch in batches:
            hashes = []
            columns = (batch.column(c).to_pylist() for c in ("lang", "phrase"))
            for lang, phrase in zip(*columns, strict=True):
                word = _word_hashes(phrase.split(" "), lang)
                hashes.append(reduce(_longer, word[1:, None], word[:1]))
            if hashes:
                for place, bit in table.places(np.concatenate(hashes)):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(place.astype(np.int32)),
                            pa.array((np.uint64(1) << bit).view(np.int64)),
                        ],
                        ["slot", "mask"],
                    )

    found = frequent.select("lang", "phrase").mapInArrow(run, SLOTS)
    return found.groupBy("slot").agg(F.bit_or("mask").alias("mask"))


def _phrases(words: pa.Array, ids: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    parts = [words.take(pa.array(ids[at + k])) for k in range(size)]
    return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " ")


def counted(
    words: pa.Array,
    own: np.ndarray,
    ids: np.ndarray,
    frequent: Frequent,
    recent: Frequent,
    words_too: bool,
    longest: int,
) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Counts of one row's active phrases by length: size, phrases, numbers.

    A phrase is active if both its subphrases are frequent and one of them has
    become so within the last cycle.
    """
    place = np.flatnonzero(ids >= 0)
    gram = ids[place].astype(np.int64)  # the phrase of the present length that begins there
    if words_too:
        yield 1, words, np.bincount(gram, minlength=len(words))
    h = own
    for size in range(2, longest + 1):
        is_frequent, is_recent = frequent.holds(h), recent.holds(h)
        if not is_frequent.any():
            return
        # A phrase begins where two of one word less begin one after the other.
        first = np.flatnonzero(
            (place[1:] == place[:-1] + 1) & is_frequent[gram[:-1]] & is_frequent[gram[1:]]
        )
        pair = pa.array(gram[first] * len(h) + gram[first + 1]).dictionary_encode()
        number = pair.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        prefix, suffix = np.divmod(pair.dictionary.to_numpy(zero_copy_only=False), len(h))
        place = place[first]
        example = np.zeros(len(prefix), np.int64)
        example[number] = place
        active = is_recent[prefix] | is_recent[suffix]
        if active.any():
            n = np.bincount(number, minlength=len(prefix))
            yield size, _phrases(words, ids, example[active], size), n[active]
        h = _longer(h[prefix], own[ids[example + size - 1]])
        gram = number


def _scan(rows: DataFrame, shared: Broadcast, words_too: bool, longest: int) -> DataFrame:
    """Counts of the active phrases of some rows; ``shared`` are both bit tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                lang, ids = (batch.column(c)[k].as_py() for c in ("lang", "ids"))
                ids = np.frombuffer(ids, np.int32)
                words = batch.column("vocabulary").slice(k, 1).flatten()
                own = _word_hashes(words.to_pylist(), lang)
                for size, phrases, n in counted(words, own, ids, *shared.value, words_too, longest):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(lang, len(n)),
                            pa.array(np.full(len(n), size, np.int32)),
                            phrases,
                            pa.array(n.astype(np.int64)),
                        ],
                        ["lang", "size", "phrase", "n"],
                    )

    return rows.select("lang", "vocabulary", "ids").mapInArrow(run, FOUND)


def _written(df: DataFrame, path: str) -> DataFrame:
    with short_lived_shuffles(df.sparkSession):
        df.write.option("compression", PACKING).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def phrase_counts(
    rows: DataFrame,
    scratch: Scratch,
    least: int = LEAST,
    longest: int = LONGEST,
    count: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """``lang``, ``size``, ``phrase`` and ``n`` of all phrases that occur ``least`` times.

    ``rows`` is what ``shards`` returns, written and read again. The state of
    phrases under way (their counts by shard) is written after each step. Before
    it is shuffled again, phrases leave it that have a count from every shard, or
    none from the last cycle, and all words after the first cycle. Should the bit
    table bring one back, its sum can only be too small, and the largest sum of a
    phrase counts; it is new in the first step that found it frequent.
    """
    spark = rows.sparkSession
    held = [f"n_{s}" for s in range(count)]
    state, path = None, None
    frequent_path = scratch.path("frequent")
    frequent = Frequent(bits)
    news: list[np.ndarray] = []  # the bits that each step has set
    last = 0
    step = 0
    while step <= last + count:
        shard = step % count
        others = [c for c in held if c != held[shard]]
        recent = Frequent(bits)
        for new in news[-count:]:
            recent.words |= new
        shared = spark.sparkContext.broadcast((frequent, recent))
        fresh = _scan(rows.where(F.col("shard") == shard), shared, step < count, longest)
        nothing = F.lit(None).cast("long")
        both = fresh.select("lang", "size", "phrase", "n", *(nothing.alias(c) for c in held))
        if state is not None:
            some = reduce(or_, (F.col(c).isNotNull() for c in others), F.lit(False))
            lacks = reduce(or_, (F.col(c).isNull() for c in held))
            former = state.where(some & lacks)
            if step >= count:
                former = former.where(F.col("size") > 1)
            former = former.withColumn(held[shard], nothing).withColumn("n", nothing)
            both = former.unionByName(both)
        sums = both.groupBy("lang", "size", "phrase").agg(
            *(F.max(c).alias(c) for c in others), F.sum("n").alias(held[shard])
        )
        total = reduce(add, [F.coalesce(F.col(c), F.lit(0)) for c in held])
        newer = scratch.path("state")
        state = _written(sums.select("lang", "size", "phrase", *held), newer)
        shared.destroy()
        if path is not None:
            scratch.release(path)
        path = newer
        state.where(total >= least).select(
            "lang", "size", "phrase", total.alias("n"), F.lit(step).alias("step")
        ).write.mode("append").parquet(frequent_path)
        new = np.zeros(bits // 64, np.uint64)
        known = spark.read.schema(KNOWN).parquet(frequent_path)
        reached = known.groupBy("lang", "size", "phrase").agg(F.min("step").alias("reached"))
        added = reached.where(F.col("reached") == step)
        for batch in _slots(added, bits).toArrow().to_batches():
            slot, mask = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "mask"))
            new[slot] = mask.view(np.uint64)
        if new.any():
            last = step
        news.append(new)
        frequent.words |= new
        step += 1
    found = spark.read.schema(KNOWN).parquet(frequent_path).groupBy("lang", "size", "phrase")
    return found.agg(F.max("n").alias("n"))


def _words_of(phrase: Column, first: Column, number: Column) -> Column:
    return F.array_join(F.slice(phrase, first, number), " ")


def collocations(
    documents: DataFrame,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    count: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is cut where 1000 * a * n / (l * r) is least; a phrase that always
    stands within a longer one is dropped. Null texts count as empty, a null
    ``lang`` as ``und``; repeated rows count as often as they come; an empty
    table, or a language without a frequent phrase, gives no row. A very long
    text is counted whole. ``rank`` breaks ties by a, then by the phrase's bytes.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "collocations")
    path = scratch.path("shards")
    made = shards(documents, count).write.option("parquet.block.size", 1 << 24)
    made.partitionBy("shard").option("compression", PACKING).parquet(path)
    rows = spark.read.schema(SHARD_ROWS).parquet(path)
    known = scratch.stage(phrase_counts(rows, scratch, least, longest, count, bits), "counts")
    total = rows.groupBy("lang").agg(F.sum("words").alias("n"))

    # Whoever contains a phrase and is as frequent does so through phrases one word longer.
    split = F.split("phrase", " ")
    within = (
        known.where(F.col("size") > 2)
        .select(
            "lang",
            F.col("n").alias("longer"),
            F.explode(
                F.array(
                    _words_of(split, F.lit(1), F.col("size") - 1),
                    _words_of(split, F.lit(2), F.col("size") - 1),
                )
            ).alias("phrase"),
        )
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("longer"))
    )
    kept = known.where(F.col("size") > 1).join(within, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") < F.col("n"))
    )
    cuts = kept.select(
        "lang", "phrase", F.col("n").alias("a"), "size",
        F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"),
    ).withColumns(
        {
            "left": _words_of(split, F.lit(1), F.col("cut")),
            "right": _words_of(split, F.col("cut") + 1, F.col("size") - F.col("cut")),
        }
    )
    first = known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))

    scored = (
        cuts.join(first, ["lang", "left"])
        .join(rest, ["lang", "right"])
        .join(F.broadcast(total) if total.count() <= 10_000 else total, "lang")
        .withColumn("score", F.expr(SCORE))
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("cut")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    return (
        best.withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
           AS text
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)
), grams AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS size))
), known AS (
  SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM known WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w
  FROM known WHERE size > 1 AND n >= 100
), inside AS (
  SELECT DISTINCT p.lang, p.phrase
  FROM (SELECT lang, a, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM (SELECT lang, a, w, k, unnest(range(1, size - k + 2)) AS i
              FROM candidates, (SELECT unnest([2, 3, 4]) AS k) WHERE k < size)) q
  JOIN candidates p ON p.lang = q.lang AND p.phrase = q.phrase AND q.a >= p.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, array_to_string(w[1 : k], ' ') AS first,
         array_to_string(w[k + 1 : size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase)
), scored AS (
  SELECT c.lang, c.phrase, c.a, f.n AS l, r.n AS r, t.n AS n, k,
         CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(f.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cuts c JOIN total t ON t.lang = c.lang
  JOIN known f ON f.lang = c.lang AND f.phrase = c.first
  JOIN known r ON r.lang = c.lang AND r.phrase = c.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
