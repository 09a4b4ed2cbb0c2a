"""The driver's tables seen as folders of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.simhash import simhash
from nearfold.schema import MAPPED_IMAGE

#: Extensions in the rotation of document ids.
ROTATION = ("jpg", "jpeg", "png", "jfif", "PNG", "gif")

#: Folders in the rotation of document ids, below the source's name.
FOLDERS = ("", "/.trash", ".trash", "/.trash/sub", "/x")


def mapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAPPED_IMAGE and side: documents, hashed by SimHash, with a resolution from orders,
    a time from events and a flag from labels."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    docs = read("documents")
    hashes = simhash(docs, "doc_id", "text")
    orders = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").cast("long").alias("resolution"))
    times = read("events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("last_write_time"))
    gray = read("labels").select("doc_id", (F.col("quality") == 0).alias("_gray"))
    ext = F.element_at(F.array(*map(F.lit, ROTATION)), (F.col("doc_id") % len(ROTATION) + 1).cast("int"))
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    joined = docs.drop("text").join(hashes, "doc_id").join(orders, "doc_id").join(times, "doc_id").join(gray, "doc_id", "left")
    side = F.when(F.col("doc_id") % 2 == 0, "source").otherwise("destination")
    return joined.withColumns({"id": F.col("doc_id"), "physical_path": path, "size": F.col("n_chars"), "is_grayscale": F.coalesce("_gray", F.lit(False)), "side": side}).select(*MAPPED_IMAGE.names, "side")


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, physical_path in folders of all kinds, is_symlink: a listing to filter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    ext = F.element_at(F.array(*map(F.lit, ROTATION)), (F.col("doc_id") % len(ROTATION) + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    path = F.concat(F.lit("/lib/"), "source", folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select(F.col("doc_id").alias("id"), path.alias("physical_path"), (F.col("n_chars") % 7 == 0).alias("is_symlink"))


def mapped_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, physical_path and hash of the benchmark's items: an explicit list to compare."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hashes = simhash(items, "item_id", "text")
    return hashes.select(F.col("item_id").alias("id"), F.concat(F.lit("/list/"), F.col("item_id").cast("string")).alias("physical_path"), "hash")
