"""What the operators share: reading tables, cutting lineage, whole-text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.tables import dropped, forget, shared_folder, steady, stored

__all__ = ["WORD", "crc_remainder", "dropped", "first_share", "forget", "fresh", "give_back", "shared_folder", "slices", "small_batches", "steady", "stored", "table"]

#: ASCII white space; every other code point belongs to a word. As regex class members.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def slices(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most `rows` rows and, but for single rows, `chars` bytes of
    the column, so that a worker's memory follows one slice and never a partition."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(at + rows, int(np.searchsorted(ends, before + chars, side="right")))
            stop = max(stop, at + 1)
            yield batch.slice(at, stop - at)
            at = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: an idle worker keeps what its last partition
    took at most, and several of them share an executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fresh(name: str, taken: list[str]) -> str:
    """A working column name that no input column has (names compare case-insensitively)."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def crc_remainder(column: str, n: int):
    """crc32(id as text) mod n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def first_share(wanted: int, total: int) -> int:
    """The signed 64-bit hash up to which `wanted` of `total` evenly spread hashes lie:
    exact at every size, one at least."""
    return min((1 << 63) - 1, -(1 << 63) + (max(1, wanted) << 64) // max(1, total))
