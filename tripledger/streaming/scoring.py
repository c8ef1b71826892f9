"""Continuous scoring of arriving forecast requests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripledger.models.bundle import load, newest_run
from tripledger.models.hybrid import HybridModel, forecast, is_complete
from tripledger.session import path_exists


def _append(rows: DataFrame, output: str, progress: str, available_now: bool) -> StreamingQuery:
    writer = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", progress)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def score_stream(
    model: HybridModel,
    requests: DataFrame,
    output_path: str,
    checkpoint_path: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append forecasts for a stream of requests to a Parquet folder.

    Scoring is stateless, so no watermark is needed. Offsets and output commits
    live in shared folders: a restarted query neither loses nor repeats rows. A
    request without a usable day or number of days is left out, so it cannot
    stop the others; ``reject_stream`` keeps such requests.
    """
    scored = forecast(model, requests.filter(is_complete()))
    return _append(scored, output_path, checkpoint_path, available_now)


def reject_stream(
    requests: DataFrame, output_path: str, checkpoint_path: str, available_now: bool = False
) -> StreamingQuery:
    """Append the requests that ``score_stream`` leaves out to a Parquet folder."""
    return _append(requests.filter(~is_complete()), output_path, checkpoint_path, available_now)


def _stream_name(spark: SparkSession, checkpoint_path: str) -> str:
    """A name that lives as long as the checkpoint: batch numbers start again with a new one."""
    path = f"{checkpoint_path.rstrip('/')}/stream_name"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        name = spark.createDataFrame([(uuid.uuid4().hex,)], "name string")
        name.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["name"]


def score_stream_with_newest(
    spark: SparkSession,
    bundle_path: str,
    requests: DataFrame,
    output_path: str,
    checkpoint_path: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Like ``score_stream``, with the newest saved bundle for each micro-batch.

    A micro-batch asks the manifest for the newest run and loads it only if it
    is another one than before, so a bundle saved while the stream runs is used
    from the next batch on. ``model_run`` of a row names the bundle. Each batch
    has a folder of its own, ``stream=<name>/batch=<number>``, which columns of
    these names repeat on reading: a batch that is tried again after a failure
    replaces its folder, and a finished one is left as it is, so a restart
    repeats nothing. Without a bundle at the start it is a ``FileNotFoundError``.
    """
    taken = {"model_run", "stream", "batch"} & {c.lower() for c in requests.columns}
    if taken:
        raise ValueError(f"requests have columns named {sorted(taken)}")
    newest_run(spark, bundle_path)
    target = f"{output_path.rstrip('/')}/stream={_stream_name(spark, checkpoint_path)}"
    held: dict[str, HybridModel] = {}

    def score(batch: DataFrame, number: int) -> None:
        folder = f"{target}/batch={number}"
        if path_exists(spark, f"{folder}/_SUCCESS"):
            return
        run = newest_run(spark, bundle_path)
        if run not in held:
            held.clear()
            held[run] = load(spark, bundle_path, run)
        scored = forecast(held[run], batch.filter(is_complete()))
        scored.withColumn("model_run", F.lit(run)).write.mode("overwrite").parquet(folder)

    writer = requests.writeStream.foreachBatch(score).option(
        "checkpointLocation", f"{checkpoint_path.rstrip('/')}/progress"
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
