"""Secret scans with an incremental ledger of content-addressed texts.

Every version of every document is addressed by the SHA-256 of its text. The
ledger, a Parquet folder that only ever grows, holds one row for each scanned
pair of blob and rule version, found or not. A run scans the pairs it has not
seen, appends them, and joins the findings back to every document that holds
the blob. A new rule, or a new version of one, makes every blob unseen for that
rule alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.common import fresh, map_batches, read_table, texts_of
from tripledger.session import scratch_path

#: Findings that may be broadcast, under 100 bytes each; beyond that they are joined.
BROADCAST_SPANS = 200_000
SPAN = "array<struct<start:long,end:long>>"
LEDGER = f"blob binary, rule string, version int, spans {SPAN}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a pattern, kept where ``keeps`` says so.

    ``hints``: the pattern cannot match unless one of them is in the text with
    its ASCII letters lowered. ``base`` rules count towards the digest.
    """

    kind: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()
    folded: bool = False
    keeps: Callable[[re.Match], bool] | None = None
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.folded else 0))


# Kinds in their fixed order; the first three are the base kinds.
RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        hints=("password", "passwd", "secret", "token", "apikey", "api_key"),
        folded=True,
        keeps=lambda m: len(m[2]) >= 6,
        base=True,
    ),
    Rule(
        "access",
        1,
        r"AKIA[A-Z0-9]+",
        hints=("akia",),
        keeps=lambda m: len(m[0]) >= 20,
        base=True,
    ),
    # A run of 24 or more is the whole run, so the length can stand in the pattern.
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule(
        "private_key",
        1,
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?",
        hints=("private key-----",),
    ),
    Rule(
        "web_token",
        1,
        r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
        hints=("eyj",),
    ),
)


def spans_in(text: str, rule: Rule, pattern: re.Pattern, folded: str) -> list[dict]:
    """Code-point spans, end exclusive."""
    if rule.hints and not any(h in folded for h in rule.hints):
        return []
    return [
        {"start": m.start(), "end": m.end()}
        for m in pattern.finditer(text)
        if rule.keeps is None or rule.keeps(m)
    ]


def _address(documents: DataFrame) -> DataFrame:
    return texts_of(documents).withColumn("blob", F.unhex(F.sha2(F.col("text"), 256)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger, or None before its first run; a damaged one raises."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(documents: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan the unseen pairs of blob and rule version, append them, return the ledger.

    Copies are reduced before the shuffle, so a text that a third of all rows
    hold travels once for each task that met it, and is scanned once.
    """
    spark = documents.sparkSession
    blobs = _address(documents).groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    ledger = read_ledger(spark, path)
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.groupBy("blob").agg(
            F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen")
        )
        todo = (
            blobs.join(seen, "blob", "left")
            .withColumn(
                "todo",
                F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))),
            )
            .where(F.size("todo") > 0)
        )
    by_name = {f"{r.kind}:{r.version}": (r, r.compiled()) for r in rules}

    def rows(batch: pa.RecordBatch):
        blob, rule, version, spans = [], [], [], []
        for address, text, names in zip(
            batch.column(0).to_pylist(),
            batch.column(1).to_pylist(),
            batch.column(2).to_pylist(),
            strict=True,
        ):
            folded = text.lower()
            for name in names:
                which, pattern = by_name[name]
                blob.append(address)
                rule.append(which.kind)
                version.append(which.version)
                spans.append(spans_in(text, which, pattern, folded))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(blob, pa.binary()),
                pa.array(rule, pa.string()),
                pa.array(version, pa.int32()),
                pa.array(spans, kind),
            ],
            ["blob", "rule", "version", "spans"],
        )

    map_batches(todo.select("blob", "text", "todo"), rows, LEDGER).write.mode("append").parquet(
        path
    )
    return spark.read.schema(LEDGER).parquet(path)


def _hits(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob`` and ``found`` of every blob with a finding of the current rules."""
    place = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
    current = F.concat_ws(":", "rule", "version").isin([f"{r.kind}:{r.version}" for r in rules])
    return (
        ledger.where(current & (F.size("spans") > 0))
        .dropDuplicates(["blob", "rule"])  # two runs at once may have scanned the same pair
        .select("blob", "rule", F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.col("s.start"),
                        place[F.col("rule")].alias("place"),
                        F.col("s.end"),
                        F.col("rule").alias("kind"),
                    )
                )
            ).alias("found")
        )
    )


def findings(
    documents: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``doc_id``, ``blob`` and ``found``: kind, place of the kind, start and end, in order.

    Every row of the documents is returned; a null text counts as empty.
    """
    hits = _hits(ledger, rules)
    none = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
    return (
        _address(documents)
        .select("doc_id", "blob")
        .join(hits, "blob", "left")
        .select("doc_id", "blob", F.coalesce("found", none).alias("found"))
    )


def scan(documents: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger at ``path`` up to date and return the findings of every document."""
    return findings(documents, update_ledger(documents, path, rules), rules)


def redact(documents: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rows and columns, each finding in ``text`` replaced by its kind in brackets.

    Findings that overlap an earlier one go with it. Null texts stay null.
    """
    ledger = update_ledger(documents.select("doc_id", "text"), path, rules)
    found, hit, held = (fresh(documents, name) for name in ("found", "hit_blob", "redacted"))
    hits = _hits(ledger, rules).select(F.col("blob").alias(hit), F.col("found").alias(found))
    spans = ledger.agg(F.sum(F.size("spans"))).first()[0] or 0
    if spans <= BROADCAST_SPANS:
        hits = F.broadcast(hits)
    done = F.aggregate(
        found,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda done, s: F.when(
            s["start"] >= done["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    done["out"],
                    F.substring(
                        F.col("text"),
                        (done["at"] + 1).cast("int"),
                        (s["start"] - done["at"]).cast("int"),
                    ),
                    F.lit("["),
                    s["kind"],
                    F.lit("]"),
                ).alias("out"),
            ),
        ).otherwise(
            F.struct(F.greatest(done["at"], s["end"]).alias("at"), done["out"].alias("out"))
        ),
    )
    clean = F.when(
        F.col(found).isNotNull(),
        F.concat(
            F.col(f"{held}.out"),
            F.substring(F.col("text"), (F.col(f"{held}.at") + 1).cast("int"), F.length("text")),
        ),
    ).otherwise(F.col("text"))
    blob = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return (
        documents.join(hits, blob == F.col(hit), "left")
        .withColumn(held, done)
        .select(*(clean.alias(c) if c == "text" else F.col(c) for c in documents.columns))
    )


def _joined(found):
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    base = [r.kind for r in RULES if r.base]

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(_joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias(
            "base_sha256"
        ),
        _joined(F.col("found")).alias("spans"),
    )
