"""The verbs as action plans: DataFrames that say what is to be done to which file.

Nothing here touches a file; `nearfold.plans.apply` does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.paths import file_name, under
from nearfold.functions.similarity import BITS, hamming, ratio
from nearfold.operators.groups import group_images
from nearfold.operators.keep import DEFAULT_KEEP, Keep, best_of_groups
from nearfold.operators.matches import nearest_match
from nearfold.tables import stored

DEFAULT_BAR = 96
DEFAULT_EXTENSIONS = ("jpg", "jpeg", "png", "jfif")


class Action(str, Enum):
    NOTHING = "Nothing"
    DELETE = "Delete"
    MOVE_TO_TRASH = "MoveToTrash"
    MOVE_TO_TRASH_AND_CREATE_LINK = "MoveToTrashAndCreateLink"
    DELETE_AND_CREATE_LINK = "DeleteAndCreateLink"


def action_of(name: str | Action) -> Action:
    value = name.value if isinstance(name, Action) else str(name)
    for a in Action:
        if a.value.lower() == value.lower():
            return a
    raise ValueError(f"unknown action {value!r}; one of {', '.join(a.value for a in Action)}")


def dedup_plan(images: DataFrame, bar: int = DEFAULT_BAR, keep: Sequence[str | Keep] = DEFAULT_KEEP, action: str | Action = Action.MOVE_TO_TRASH, root: str = "") -> DataFrame:
    """A row for every image that is not its group's keeper: component_id, id,
    physical_path, keeper_id, keeper_path, similarity, action, target_path (in the trash
    folder below root; null if the action moves nothing)."""
    action = action_of(action)
    grouped = stored(group_images(images, bar), "groups")
    best = best_of_groups(grouped, keep).select("component_id", F.col("id").alias("keeper_id"), F.col("physical_path").alias("keeper_path"), F.col("hash").alias("_kept"))
    moves = action in (Action.MOVE_TO_TRASH, Action.MOVE_TO_TRASH_AND_CREATE_LINK)
    target = F.concat(F.lit(root.rstrip("/") + "/.trash/"), file_name(F.col("physical_path"))) if moves else F.lit(None).cast("string")
    return grouped.join(best, "component_id").where("id <> keeper_id").select("component_id", "id", "physical_path", "keeper_id", "keeper_path", ratio(hamming(F.col("hash"), F.col("_kept"))).alias("similarity"), F.lit(action.value).alias("action"), target.alias("target_path"))


def dedup_summary(images: DataFrame, bar: int = DEFAULT_BAR) -> DataFrame:
    """One row: images, groups (of two or more), grouped_images, duplicates."""
    sizes = group_images(images, bar, keep_singletons=True).groupBy("component_id").agg(F.count("*").alias("n"))
    many = F.col("n") > 1
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("images"), F.count_if(many).alias("groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("grouped_images"), F.coalesce(F.sum(F.when(many, F.col("n") - 1)), F.lit(0)).alias("duplicates"))


def copy_plan(source: DataFrame, destination: DataFrame, bar: int = DEFAULT_BAR, keep: Sequence[str | Keep] = DEFAULT_KEEP, source_root: str = "", destination_root: str = "") -> DataFrame:
    """A row for the best image of every source group, lone images included: decision
    `skip` if the destination has a similar one (match_id, match_path, match_distance),
    else `copy` to target_path. Only the best image is compared, not all of its group."""
    best = best_of_groups(group_images(source, bar, keep_singletons=True), keep)
    judged = nearest_match(best, destination, bar)
    copies = F.col("match_id").isNull()
    target = F.when(copies, under(destination_root, F.col("physical_path"), source_root))
    return judged.select("component_id", "id", "physical_path", F.when(copies, "copy").otherwise("skip").alias("decision"), "match_id", "match_path", "match_distance", target.alias("target_path"))


def copy_summary(plan: DataFrame, source: DataFrame) -> DataFrame:
    """One row: images, groups, copied, skipped."""
    done = plan.agg(F.count("*").alias("groups"), F.count_if(F.col("decision") == "copy").alias("copied"), F.count_if(F.col("decision") == "skip").alias("skipped"))
    return source.agg(F.count("*").alias("images")).join(F.broadcast(done))  # one row each


def patch_groups(source: DataFrame, destination: DataFrame, bar: int = DEFAULT_BAR) -> DataFrame:
    """The groups of both folders together, with the side of every image; stored."""
    both = source.withColumn("side", F.lit("source")).unionByName(destination.withColumn("side", F.lit("destination")))
    return stored(group_images(both, bar), "groups")


def patch_plan(source: DataFrame, destination: DataFrame, bar: int = DEFAULT_BAR, keep: Sequence[str | Keep] = DEFAULT_KEEP, grouped: DataFrame | None = None) -> DataFrame:
    """A row for every destination image whose group's best image lies in the source:
    component_id, id, physical_path, keeper_id, keeper_path, similarity. Ids must differ
    between source and destination. grouped: what patch_groups gave, if it is known."""
    grouped = patch_groups(source, destination, bar) if grouped is None else grouped
    best = best_of_groups(grouped, keep).where("side = 'source'").select("component_id", F.col("id").alias("keeper_id"), F.col("physical_path").alias("keeper_path"), F.col("hash").alias("_kept"))
    return grouped.where("side = 'destination'").join(best, "component_id").select("component_id", "id", "physical_path", "keeper_id", "keeper_path", ratio(hamming(F.col("hash"), F.col("_kept"))).alias("similarity"))


def patch_summary(source: DataFrame, destination: DataFrame, grouped: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: images of both folders, groups (of two or more), grouped_images, patched."""
    images = source.select("id").unionByName(destination.select("id")).agg(F.count("*").alias("images"))
    groups = grouped.groupBy("component_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("grouped_images"))
    patched = plan.agg(F.count("*").alias("patched"))
    return images.join(F.broadcast(groups)).join(F.broadcast(patched))  # one row each


def described(plan: DataFrame, images: DataFrame) -> DataFrame:
    """A dedup plan with resolution, size and is_grayscale of every image and, prefixed with
    keeper_, of its keeper, group by group."""
    details = ("resolution", "size", "is_grayscale")
    own = images.select("id", *details)
    keepers = images.select(F.col("id").alias("keeper_id"), *(F.col(c).alias(f"keeper_{c}") for c in details))
    return plan.join(own, "id").join(keepers, "keeper_id").orderBy("component_id", "id")


def compare(images: DataFrame, distance: Callable[[Column, Column], Column] = hamming) -> DataFrame:
    """id_a, id_b, path_a, path_b, similarity of every pair of an explicit list of images,
    id_a < id_b. All pairs are what is asked for; Spark chooses by the size of the list
    whether one side is broadcast. distance: the metric, from two hash columns."""
    a, b = (images.select(F.col("id").alias(f"id_{x}"), F.col("physical_path").alias(f"path_{x}"), F.col("hash").alias(f"hash_{x}")) for x in "ab")
    return a.join(b, F.col("id_a") < F.col("id_b")).select("id_a", "id_b", "path_a", "path_b", ratio(distance(F.col("hash_a"), F.col("hash_b"))).alias("similarity"))


def top_similar(images: DataFrame, query_hash: int, top: int = 15, distance: Callable[[Column, Column], Column] = hamming) -> DataFrame:
    """The `top` images most similar to a hash: physical_path, similarity; of equals, the
    lesser path first. distance: the metric, from two hash columns."""
    if not -(1 << (BITS - 1)) <= query_hash < 1 << (BITS - 1):
        raise ValueError("a hash is a signed 64-bit number")
    scored = images.select("physical_path", ratio(distance(F.col("hash"), F.lit(query_hash).cast("long"))).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "physical_path").limit(top)
