"""Trips kept up to date: mergeable trip states, one small table for each batch of lines."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tripledger.operators.rollup import line_states, merge_states, rolled_states
from tripledger.session import delete_path

_MANIFEST = (
    "entry string, level int, batch string, replaces array<string>, schema string, "
    "saved_at timestamp"
)


def _schema_of(entry: Row) -> StructType:
    return StructType.fromJson(json.loads(entry["schema"]))


class TripStore:
    """A folder of trip states that grows by batches of lines.

    A batch is reduced to one state for each of its trips and written; earlier
    lines and states are not read. Reading merges the states of a trip. Once
    ``fan`` entries of one level have come together, they are merged into one
    entry of the next level, so a state is rewritten only as often as the
    logarithm of the number of batches, and a read meets few entries.

    The result never depends on how lines are dealt out to batches or in which
    order those arrive: sums add up (decimal amounts exactly, doubles but for
    rounding), and a fact comes from the smallest ``row_ord`` that has it, so a
    late line with a smaller one still wins. ``row_ord`` must therefore order
    the lines of a trip over all batches.

    An entry counts from the moment its manifest row is written; what a lost
    job leaves behind before that is never read. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 8):
        if fan < 2:
            raise ValueError("fan must be 2 or more")
        self.spark = spark
        self.path = path.rstrip("/")
        self.fan = fan

    def append(self, lines: DataFrame, batch: str) -> bool:
        """Take in a batch. One whose name is known changes nothing and returns ``False``.

        The name alone decides, so a job that is run again may repeat its batch.
        A batch without lines is remembered, too. Amounts must keep their type.
        """
        rows = self._manifest()
        if any(r["batch"] == batch for r in rows):
            return False
        states = line_states(lines)
        kind = states.schema.simpleString()
        if rows and kind != _schema_of(rows[0]).simpleString():
            known = _schema_of(rows[0]).simpleString()
            raise ValueError(f"batch {batch!r} has states of {kind}, not {known}")
        self._write(states, 0, batch, [])
        self._compact()
        return True

    def states(self) -> DataFrame:
        """One state for each trip."""
        live = self._live(self._manifest())
        if not live:
            raise FileNotFoundError(f"no batch in {self.path}")
        return merge_states(self._read(live))

    def rolled(self) -> DataFrame:
        """What :func:`roll_up` gives for the lines of all batches."""
        return rolled_states(self.states())

    def vacuum(self) -> int:
        """Delete the entries that others replaced; readers of older results must be done."""
        rows = self._manifest()
        old = {name for r in rows for name in r["replaces"]}
        for name in old:
            delete_path(self.spark, f"{self.path}/entries/{name}")
        return len(old)

    def _manifest(self) -> list[Row]:
        """The manifest: one short row for each batch or merge."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    @staticmethod
    def _live(rows: Iterable[Row]) -> list[Row]:
        rows = list(rows)
        replaced = {name for r in rows for name in r["replaces"]}
        return [r for r in rows if r["entry"] not in replaced]

    def _read(self, entries: list[Row]) -> DataFrame:
        paths = [f"{self.path}/entries/{r['entry']}" for r in entries]
        return self.spark.read.schema(_schema_of(entries[0])).parquet(*paths)

    def _write(self, states: DataFrame, level: int, batch: str | None, replaces: list[str]) -> None:
        entry = uuid.uuid4().hex
        states.write.option("compression", "zstd").parquet(f"{self.path}/entries/{entry}")
        row = (entry, level, batch, replaces, states.schema.json())
        self.spark.createDataFrame([row], _MANIFEST.replace(", saved_at timestamp", "")).withColumn(
            "saved_at", F.current_timestamp()
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _compact(self) -> None:
        """Merge full levels from below; one manifest row replaces the merged entries."""
        level = 0
        while True:
            live = self._live(self._manifest())
            full = [r for r in live if r["level"] == level]
            if len(full) >= self.fan:
                merged = merge_states(self._read(full))
                self._write(merged, level + 1, None, [r["entry"] for r in full])
            elif not any(r["level"] > level for r in live):
                return
            level += 1
