"""Sliding windows over exactly ranked rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQUENCE_LENGTH = 60
BLOCK_ROWS = 2_048
# Windows per partition; with 60 steps of four fields about 100 MB as vectors.
ROWS_PER_PARTITION = 32_768

STEP_FIELDS = ("y", "duration", "home_idx", "dest_idx")


def step(y: Column, duration: Column, home_idx: Column, dest_idx: Column) -> Column:
    """One step of a window; countries stay positions until they reach a learner."""
    return F.struct(
        y.cast("double").alias("y"),
        duration.cast("double").alias("duration"),
        home_idx.cast("int").alias("home_idx"),
        dest_idx.cast("int").alias("dest_idx"),
    )


def with_history(
    ranked: DataFrame,
    value: Column,
    rows: int,
    length: int = SEQUENCE_LENGTH,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows with ``length`` predecessors, each with the array ``history`` of them.

    Rows are cut into blocks of positions. The last ``length`` rows of a block
    are also copied to the next one, so each block holds whole windows and
    blocks run in parallel; a copy costs ``length / block_rows`` extra rows.

    A window is many times larger than its row, so the number of partitions
    follows the number of ``rows``, not the bytes that are shuffled.
    """
    if block_rows < length:
        raise ValueError("a block must be at least as long as a window")
    own = F.floor(F.col("rn") / block_rows)
    blocks = F.when(
        F.col("rn") % block_rows >= block_rows - length, F.array(own, own + 1)
    ).otherwise(F.array(own))
    cores = ranked.sparkSession.sparkContext.defaultParallelism
    partitions = max(min(cores, rows // block_rows + 1), math.ceil(rows / ROWS_PER_PARTITION))
    frame = Window.partitionBy("block").orderBy("rn").rowsBetween(-length, -1)
    return (
        ranked.withColumn("step", value)
        .withColumn("block", F.explode(blocks))
        .repartition(partitions, "block")
        .withColumn("history", F.collect_list("step").over(frame))
        .filter((own == F.col("block")) & (F.size("history") == length))
        .drop("block", "step")
    )


def request_window(history: Column, request_step: Column) -> Column:
    """The last steps of the past followed by the request as the newest step."""
    return F.concat(history, F.array(request_step))
