"""Semi- and anti-joins by similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.similarity import BITS, hamming, max_distance
from nearfold.operators.edges import close_hashes
from nearfold.tables import stored


def nearest_match(images: DataFrame, others: DataFrame, bar: int) -> DataFrame:
    """images with match_id, match_path and match_distance of the most similar image of
    `others` that reaches the bar (of equals, the lesser path, then id); nulls if none."""
    k = max_distance(bar)
    columns = images.columns
    if k < 0:
        return images.withColumns({"match_id": F.lit(None).cast("long"), "match_path": F.lit(None).cast("string"), "match_distance": F.lit(None).cast("int")})
    holders = stored(others.groupBy("hash").agg(F.min(F.struct(F.col("physical_path").alias("path"), "id")).alias("who")), "hashes")
    mine = stored(images.select("hash").distinct(), "hashes")
    pairs = close_hashes(mine, holders.select("hash"), min(k, BITS - 1))
    best = pairs.join(holders.withColumnRenamed("hash", "hash_b"), "hash_b").groupBy("hash_a").agg(F.min(F.struct("dist", "who.path", "who.id")).alias("m"))
    out = images.join(best.withColumnRenamed("hash_a", "hash"), "hash", "left")
    return out.select(*columns, F.col("m.id").alias("match_id"), F.col("m.path").alias("match_path"), F.col("m.dist").alias("match_distance"))


def without_match(images: DataFrame, others: DataFrame, bar: int) -> DataFrame:
    """The images that nothing in `others` is similar to."""
    return nearest_match(images, others, bar).where("match_id is null").select(*images.columns)


def with_match(images: DataFrame, others: DataFrame, bar: int) -> DataFrame:
    """The images that something in `others` is similar to."""
    return nearest_match(images, others, bar).where("match_id is not null").select(*images.columns)


def range_search(images: DataFrame, query_hash: int, most: int, distance: Callable[[Column, Column], Column] = hamming) -> DataFrame:
    """images with distance, those at distance `most` or less from a hash. distance: the
    metric, from two hash columns; any will do, as every image is looked at once."""
    far = distance(F.col("hash"), F.lit(query_hash).cast("long")).cast("int")
    return images.withColumn("distance", far).where(F.col("distance") <= most)
