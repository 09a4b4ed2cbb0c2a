"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only used where the session names no shared folder and runs on this machine alone.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: Plans that give the same rows in the same order when a task runs again.
STEADY = frozenset(("Project", "Filter", "LogicalRelation", "LogicalRDD", "LocalRelation", "Range", "SubqueryAlias"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_CHECKPOINTS
    raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: lineage ends
    here, and a lost executor costs no more than the stage that was running."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/nearfold-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._nearfold_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the size of texts or images."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def steady(frame: DataFrame, label: str) -> DataFrame:
    """The frame itself if its rows come straight from files, in an order that a task that
    runs again repeats; else the frame stored."""
    todo = [frame._jdf.queryExecution().optimizedPlan()]
    if not todo[0].deterministic():
        return stored(frame, label)
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in STEADY:
            return stored(frame, label)
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return frame


_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(frame: DataFrame | None) -> None:
    """Delete the table of a frame that stored() returned, once what was made from it is
    stored itself. Other frames are left alone."""
    path = getattr(frame, "_nearfold_path", None)
    if path:
        spark = frame.sparkSession
        _written[spark.sparkContext.applicationId].remove(path)
        _delete(spark, path)


def forget(spark: SparkSession) -> None:
    """Delete what stored() wrote in this application; frames that read it no longer work."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
