"""Session defaults, the shared scratch folder and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Options set on a session only where its owner has not set them.
RUNTIME_DEFAULTS = {
    # A hot key in a join that feeds an aggregation on the same key is split
    # too, at the price of one more exchange for that join only.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(
    app_name: str = "tripledger", cores: int | None = None, shared: str | None = None
) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cores = cores or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRIPLEDGER_DRIVER_MEMORY", "8g"))
    )
    if shared is not None:
        builder = builder.config("spark.checkpoint.dir", shared)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_runtime_defaults(spark)


def apply_runtime_defaults(spark: SparkSession) -> SparkSession:
    chosen = spark.conf.getAll
    for key, value in RUNTIME_DEFAULTS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor reaches, named by the session.

    Only a local session may go without it: it gets a temporary folder. On a
    cluster a machine-local folder would be lost with its machine, so an unset
    folder is an error there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tripledger-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tripledger/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Later passes read only the columns they need, and a lost executor costs a
    re-read instead of the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever it lies; a missing one is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of some 4 MB, not of 10,000 rows whatever their length.

    Both sides hold a batch or two of each task beside the heap, so that long texts
    would take an executor's memory. The session's own choice, if any, stands.
    """
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, "4m")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in this block takes its shuffle files along when it is done.

    Else they stay until the driver collects its garbage, so that a job of many
    written steps holds the shuffles of all of them. A write has shuffles of its
    own, which nothing reads later. The session's own choice, if any, stands.
    """
    if CLEAN_UP in spark.conf.getAll:
        yield
        return
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP)


class Scratch:
    """Staged tables of one job, deleted together (or one by one) when it is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once below the job's folder and go on from the written table."""
        return self._stage_at(df, self.path(name))

    def _stage_at(self, df: DataFrame, path: str) -> DataFrame:
        with short_lived_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, path: str | None = None) -> None:
        """Delete one staged path, or all of the job; later reads of them fail."""
        delete_path(self.spark, path or self.root)

