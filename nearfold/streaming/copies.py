"""dedup-copy over a stream of mapped images: each micro-batch is decided against a table
of what was taken before, so running it again takes nothing twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfold.operators.keep import DEFAULT_KEEP, Keep, best_of_groups
from nearfold.operators.groups import group_images
from nearfold.operators.matches import without_match
from nearfold.schema import MAPPED_IMAGE


def take_new(batch: DataFrame, known: DataFrame, bar: int, keep: Sequence[str | Keep] = DEFAULT_KEEP) -> DataFrame:
    """The best image of every group of the batch that nothing known is similar to."""
    best = best_of_groups(group_images(batch, bar, keep_singletons=True), keep)
    return without_match(best.select(*MAPPED_IMAGE.names), known, bar)


def start(stream: DataFrame, known_path: str, checkpoint: str, bar: int = 96, keep: Sequence[str | Keep] = DEFAULT_KEEP, once: bool = False) -> StreamingQuery:
    """Appends the new images of the stream to the Parquet table at known_path. A batch
    that is run again after a failure finds its own rows known."""
    spark = stream.sparkSession

    def step(batch: DataFrame, _: int) -> None:
        known = spark.read.schema(MAPPED_IMAGE).parquet(known_path)
        take_new(batch, known, bar, keep).write.mode("append").parquet(known_path)

    spark.createDataFrame([], MAPPED_IMAGE).write.mode("append").parquet(known_path)
    writer = stream.select(*MAPPED_IMAGE.names).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
