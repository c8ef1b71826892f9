"""Saving and loading a trained hybrid as a folder of models and tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.models.additive import AdditiveModel, Design
from tripledger.models.hybrid import HybridModel
from tripledger.models.lagged import LaggedModel
from tripledger.models.recurrent import RecurrentModel
from tripledger.models.sequence import SequenceModel
from tripledger.operators.scaling import MinMax
from tripledger.operators.windows import STEP_FIELDS
from tripledger.session import delete_path

_MANIFEST = (
    "run string, saved_at timestamp, train_rows long, sequence string, length int, "
    "labels array<string>, design string, intercept double, weights array<double>, "
    "shares map<string,double>, "
    "tail array<struct<y:double,duration:double,home_idx:int,dest_idx:int>>"
)
# What the manifest calls the sequence part.
_KINDS = {
    LaggedModel: "lagged", RecurrentModel: "recurrent", SequenceModel: "pipeline", type(None): "none",
}
_TABLES = (LaggedModel, RecurrentModel)


def save(model: HybridModel, path: str) -> HybridModel:
    """Write the parts to a folder of their own, then the manifest row.

    A reader takes the newest manifest row, so it sees either the former bundle
    or the whole new one. Returns the model reading its snapshot from the bundle.
    """
    spark = model.train.sparkSession
    run = uuid.uuid4().hex
    parts = f"{path}/runs/{run}"
    if isinstance(model.sequence, _TABLES):
        model.sequence.table(spark).coalesce(1).write.parquet(f"{parts}/sequence")
    elif model.sequence is not None:
        model.sequence.pipeline.write().save(f"{parts}/sequence")
    model.scaler.table(spark).coalesce(1).write.parquet(f"{parts}/scaler")
    model.train.write.parquet(f"{parts}/train")
    row = (
        run,
        model.train_rows,
        _KINDS[type(model.sequence)],
        model.length,
        list(model.labels),
        model.additive.design.to_json(),
        model.additive.intercept,
        list(model.additive.weights),
        model.shares,
        [dict(zip(STEP_FIELDS, values)) for values in model.tail],
    )
    fields = _MANIFEST.replace("saved_at timestamp, ", "")
    spark.createDataFrame([row], fields).withColumn(
        "saved_at", F.current_timestamp()
    ).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return load(spark, path)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows, newest first."""
    try:
        manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no bundle in {path}") from problem
    return manifest.orderBy(F.desc("saved_at"), F.desc("run"))


def newest_run(spark: SparkSession, path: str) -> str:
    """Name of the newest bundle; without one it is a ``FileNotFoundError``."""
    newest = _manifest(spark, path).select("run", "saved_at").first()
    if newest is None:
        raise FileNotFoundError(f"no bundle in {path}")
    return newest["run"]


def retire(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete the parts of all but the newest ``keep`` bundles; returns their names.

    Loaded models go on forecasting, their training snapshot can no longer be
    read. Manifest rows stay, so a retired run cannot be loaded by name.
    """
    if keep < 1:
        raise ValueError("keep at least the newest bundle")
    runs = [r["run"] for r in _manifest(spark, path).select("run", "saved_at").collect()]
    for run in runs[keep:]:
        delete_path(spark, f"{path}/runs/{run}")
    return runs[keep:]


def load(spark: SparkSession, path: str, run: str | None = None) -> HybridModel:
    """The newest bundle, or the one named ``run``.

    Without one it is a ``FileNotFoundError``; damage raises as it is.
    """
    manifest = _manifest(spark, path)
    newest = (manifest if run is None else manifest.where(F.col("run") == run)).first()
    if newest is None:
        raise FileNotFoundError(f"no bundle in {path}" + (f" named {run}" if run else ""))
    parts = f"{path}/runs/{newest['run']}"
    labels = tuple(newest["labels"])
    scaler = MinMax.from_table(spark.read.parquet(f"{parts}/scaler"))
    sequence = None
    for kind in _TABLES:
        if newest["sequence"] == _KINDS[kind]:
            sequence = kind.from_table(spark.read.parquet(f"{parts}/sequence"), labels, scaler)
    if newest["sequence"] == _KINDS[SequenceModel]:
        sequence = SequenceModel(PipelineModel.load(f"{parts}/sequence"), labels, scaler)
    return HybridModel(
        additive=AdditiveModel(
            Design.from_json(newest["design"]), newest["intercept"], tuple(newest["weights"])
        ),
        sequence=sequence,
        scaler=scaler,
        labels=labels,
        shares=dict(newest["shares"]),
        tail=tuple(tuple(s[f] for f in STEP_FIELDS) for s in newest["tail"]),
        train=spark.read.parquet(f"{parts}/train"),
        train_rows=newest["train_rows"],
        length=newest["length"],
    )


def load_or_train(
    spark: SparkSession, path: str, train: Callable[[], HybridModel], retrain: bool = False
) -> HybridModel:
    """The saved bundle, or a new one where none is saved or ``retrain`` is set.

    Only a missing manifest means that none is saved; a damaged bundle is an error.
    """
    if not retrain:
        try:
            return load(spark, path)
        except FileNotFoundError:
            pass
    return save(train(), path)
