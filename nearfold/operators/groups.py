"""Groups of similar images: the closure of the similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.similarity import BITS, max_distance
from nearfold.operators.components import components
from nearfold.operators.edges import close_values
from nearfold.operators.meetings import SPANNED
from nearfold.tables import stored


def group_images(images: DataFrame, bar: int, keep_singletons: bool = False) -> DataFrame:
    """images with component_id, the least id of the group, and group_size. Groups are
    connected components: two members may be further apart than the bar. Without
    keep_singletons, images that are similar to no other one are left out."""
    k = max_distance(bar)
    if k < 0:
        out = images.withColumns({"component_id": F.col("id"), "group_size": F.lit(1).cast("long")})
        return out if keep_singletons else out.where("false")
    holders = stored(images.groupBy("hash").agg(F.min("id").alias("least"), F.count("*").alias("n")), "hashes")
    if k >= BITS:
        roots = holders.withColumn("root", F.lit(0).cast("long"))
    elif k == 0:
        roots = holders.withColumn("root", F.col("hash"))
    else:
        labels = components(close_values(holders.select("hash", F.col("hash").alias("value")), k, SPANNED))
        roots = holders.join(labels.withColumnRenamed("node", "hash"), "hash", "left").withColumn("root", F.coalesce("component", "hash")).drop("component")
    sums = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("group_size"))
    named = roots.select("hash", "root").join(sums, "root").drop("root")
    if not keep_singletons:
        named = named.where("group_size > 1")
    return images.join(named, "hash").select(*images.columns, "component_id", "group_size")
