"""How far the running jobs are."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def fraction(spark: SparkSession) -> float | None:
    """Completed tasks of the active stages by all of theirs; None if none is active."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
    total = sum(s.numTasks for s in stages)
    return sum(s.numCompletedTasks for s in stages) / total if total else None


@contextmanager
def reported(spark: SparkSession, report: Callable[[float], None], every: float = 1.0) -> Iterator[None]:
    """Reports the fraction while the block runs, and 1 at its end."""
    over = threading.Event()

    def watch() -> None:
        while not over.wait(every):
            done = fraction(spark)
            if done is not None:
                report(done)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
        report(1.0)
    finally:
        over.set()
        watcher.join()
