"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a wide vector, and a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo powers of two. So the order
of paragraphs does not matter, and inserting or deleting one is an addition or
a subtraction (``combine``). The vector of a paragraph has

- eight identity lanes of 32 bits, hashes of the whole paragraph with eight seeds,
- one count lane of 32 bits, the number of the paragraph's features,
- 64 likeness lanes of 16 bits: how many features have that bit set in their hash.

Features are pairs of neighbouring words; in a paragraph of under 64 characters,
pairs of neighbouring character trigrams. Twice a likeness lane minus the count
is a sum of random signs, so the cosine of two fingerprints' signed lanes
estimates the cosine of the two multisets of features.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripledger.llm.common import read_table, texts_of

IDENTITY = 8
PACKED = 32  # longs that hold two likeness lanes each
LANES = 2 * PACKED
SHORT = 64
#: Documents of a bucket of neighbours, about.
BUCKET = 2000
BUCKETS = 50_000
LOWEST = -(2**63)


def _pieces(paragraph: Column) -> Column:
    length = F.length(paragraph)
    trigrams = F.transform(
        F.sequence(F.lit(1), F.greatest(length - 2, F.lit(1))),
        lambda k: F.substring(paragraph, k, F.lit(3)),
    )
    return F.when(length < SHORT, trigrams).otherwise(F.split(paragraph, " ", -1))


def fingerprints(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """The keys, ``fingerprint`` (hexadecimal) and ``lanes``, one row for each key.

    A null or empty text is the empty multiset: all lanes are zero. Rows that
    are partitioned by some of the keys are not shuffled again.
    """
    paragraphs = F.when(F.length(text) > 0, F.split(F.col(text), "\n", -1))
    parts = (
        rows.select(*keys, F.explode_outer(paragraphs).alias("_p"))
        .withColumn("_w", _pieces(F.col("_p")))
        .select(*keys, "_p", "_w", F.posexplode_outer("_w").alias("_i", "_x"))
        .withColumn(
            "_h",
            F.when(
                F.col("_x").isNotNull(),
                F.xxhash64("_x", F.coalesce(F.get("_w", F.col("_i") + 1), F.lit(""))),
            ),
        )
    )
    both = F.lit((1 << 32) | 1)
    sums = [
        F.sum(
            F.when(
                F.col("_i") == 0,
                F.xxhash64(F.lit(k), F.col("_p")).bitwiseAND(F.lit(0xFFFFFFFF)),
            )
        ).alias(f"_e{k}")
        for k in range(IDENTITY)
    ]
    sums += [
        F.sum(F.shiftrightunsigned("_h", s).bitwiseAND(both)).alias(f"_s{s}")
        for s in range(PACKED)
    ]
    summed = parts.groupBy(*keys).agg(F.count("_h").alias("_n"), *sums)
    zero = F.lit(0).cast("long")
    mask32 = F.lit(0xFFFFFFFF)
    identity = [F.coalesce(f"_e{k}", zero).bitwiseAND(mask32) for k in range(IDENTITY)]
    count = F.col("_n").bitwiseAND(mask32)
    low = [F.coalesce(f"_s{s}", zero).bitwiseAND(mask32) for s in range(PACKED)]
    high = [
        F.shiftrightunsigned(F.coalesce(f"_s{s}", zero), 32).bitwiseAND(mask32)
        for s in range(PACKED)
    ]
    return summed.select(*keys, F.array(*identity, count, *low, *high).alias("lanes")).select(
        *keys, "lanes", as_text("lanes").alias("fingerprint")
    )


def as_text(lanes: str) -> Column:
    """Eight digits for each lane."""
    return F.array_join(
        F.transform(F.col(lanes), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""
    )


def combine(one: str, other: str, sign: int = 1) -> Column:
    """Lanes of a document with paragraphs inserted (sign 1) or deleted (sign -1)."""
    return F.transform(
        F.arrays_zip(F.col(one).alias("a"), F.col(other).alias("b")),
        lambda x: F.pmod(x["a"] + sign * x["b"], F.lit(1 << 32)),
    )


def _signed(lanes: str) -> Column:
    """Twice each likeness lane minus the count, centred modulo 2**32.

    It wraps at 2**31 features of one text, which no text has.
    """
    count = F.col(lanes)[IDENTITY]
    return F.transform(
        F.slice(lanes, IDENTITY + 2, LANES),
        lambda c: (F.pmod(2 * c - count + (1 << 31), F.lit(1 << 32)) - (1 << 31)).cast("double"),
    )


def likeness(one: str, other: str) -> Column:
    """Estimated cosine of two documents' features, 0 to 1; equal lanes give exactly 1."""
    a, b = _signed(one), _signed(other)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(size > 0, dot(a, b) / size).otherwise(0.0)
    return (
        F.when(F.col(one) == F.col(other), 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))
        .cast("double")
    )


def _bucket_of(order: Column, bounds: list[int]) -> Column:
    """Number of bounds below a value, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            F.coalesce(F.get(held, at + step - 1) < order, F.lit(False)), at + step
        ).otherwise(at),
    )


def with_next(documents: DataFrame) -> DataFrame:
    """``bucket``, ``place``, ``ghost``, ``doc_id``, ``text`` and the next document's ``next_text``.

    The next document is the one with the next smaller doc_id; the first one
    follows the last. Rows that share an id follow each other by text; null ids
    come last. Documents are dealt into buckets of neighbouring ids by
    quantiles; the first document of the following bucket comes along as a
    ghost, so no bucket needs another, and no row is looked up.
    """
    spark = documents.sparkSession
    order = F.coalesce("doc_id", F.lit(LOWEST))
    docs = texts_of(documents).withColumn("order", order)
    total = docs.count()
    buckets = min(BUCKETS, -(-total // BUCKET))
    bounds: list[int] = []
    if buckets > 1:
        shares = [k / buckets for k in range(1, buckets)]
        found = docs.agg(
            F.percentile_approx("order", shares, max(10_000, 4 * buckets)).alias("q")
        ).first()["q"]
        bounds = sorted(set(found))
    docs = docs.withColumn("bucket", _bucket_of(F.col("order"), bounds))
    # One row for each bucket.
    tops = sorted(docs.groupBy("bucket").agg(F.max("order").alias("top")).collect())
    following = [(r["bucket"], tops[k - 1]["top"]) for k, r in enumerate(tops)]
    edges = spark.createDataFrame(following, "to int, top long")
    ghosts = docs.join(F.broadcast(edges), F.col("order") == F.col("top")).select(
        "doc_id", "text", "order", F.col("to").alias("bucket"), F.lit(1).alias("ghost")
    )
    everyone = docs.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    near = Window.partitionBy("bucket").orderBy("ghost", F.desc("order"), "text")
    return everyone.select(
        "bucket",
        F.row_number().over(near).alias("place"),
        "ghost",
        "doc_id",
        "text",
        F.lead("text").over(near).alias("next_text"),
    )


def compare_with_edits(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness.

    The edited text has its second half (the smaller one) replaced by as many
    first characters of the next document, or all it has. Null texts are empty;
    an empty table gives no row; the only document follows itself.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.length("text") - half
    edited = F.concat(
        F.substring("text", F.lit(1), kept), F.substring("next_text", F.lit(1), half)
    )
    versions = with_next(documents).withColumn("edited", edited)
    keys = ("bucket", "place", "version", "ghost", "doc_id", "n_chars", "edited_sha256")
    rows = versions.select(
        "bucket",
        "place",
        "ghost",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.when(F.col("ghost") == 0, F.sha2("edited", 256)).alias("edited_sha256"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("version"), F.col("text").alias("of")),
                F.struct(F.lit(1).alias("version"), F.col("edited").alias("of")),
            )
        ).alias("v"),
    ).select(
        "bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256", "v.version",
        F.col("v.of").alias("of"),
    ).where("version = 0 OR ghost = 0")
    prints = fingerprints(rows, "of", *keys)
    near = Window.partitionBy("bucket").orderBy("place", "version")
    return (
        prints.withColumn("edited_lanes", F.lead("lanes", 1).over(near))
        .withColumn("edited_fingerprint", F.lead("fingerprint", 1).over(near))
        .withColumn("next_lanes", F.lead("lanes", 2).over(near))
        .where("version = 0 AND ghost = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness("lanes", "edited_lanes").alias("near_edited"),
            likeness("lanes", "next_lanes").alias("near_next"),
        )
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read_table(spark, sf_dir, "documents"))
