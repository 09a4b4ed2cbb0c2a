"""Folders of images as mapped images.

Files are listed on the driver: which of them are links, and where these lead, only the
file system can tell, and Spark's own listing skips names that start with `_` or `.`.
Files are read and hashed on the executors.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.functions.pixels import ImageHash, looked_at, perceptual_hash
from nearfold.plans.dedup import DEFAULT_EXTENSIONS
from nearfold.schema import MAPPED_IMAGE
from nearfold.tables import shared_folder, small_batches

#: Columns of read_images.
COLUMNS = MAPPED_IMAGE.names

#: Paths that one reader gets; a longer list is read in parts.
PATHS_AT_ONCE = 20_000


def list_files(folder: str, recursive: bool = False, extensions: Sequence[str] = DEFAULT_EXTENSIONS, links: bool = False) -> list[str]:
    """Absolute paths, sorted. Left out: files whose immediate folder's name ends with
    .trash, links (unless `links`; then their final target is listed), other extensions."""
    if not extensions:
        raise ValueError("at least one extension is needed")
    wanted = {x.lstrip(".").lower() for x in extensions}
    folder = os.path.abspath(folder)
    if not os.path.isdir(folder):
        raise NotADirectoryError(folder)
    out = []
    for where, folders, names in os.walk(folder):
        if not recursive:
            folders.clear()
        if os.path.basename(where).endswith(".trash"):
            continue
        for name in names:
            path = os.path.join(where, name)
            if "." not in name or name.rpartition(".")[2].lower() not in wanted:
                continue
            if os.path.islink(path):
                path = os.path.realpath(path)
                if not links or not os.path.isfile(path):
                    continue
            out.append(path)
    return sorted(out)


def visible(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Path to read from: path. Spark leaves out files whose names start with _ or ., so
    these are read through links in the shared folder."""
    out = {}
    folder = None
    for i, path in enumerate(paths):
        if not os.path.basename(path).startswith(("_", ".")):
            out[path] = path
            continue
        if folder is None:
            shared = re.sub("^file:/+", "/", shared_folder(spark))
            if "://" in shared:
                raise ValueError(f"{path}: names that start with _ or . need a shared folder that is mounted, not {shared}")
            folder = os.path.join(shared, f"nearfold-names-{uuid.uuid4().hex}")
            os.makedirs(folder)
        link = os.path.join(folder, f"{i}{os.path.splitext(path)[1]}")
        os.symlink(path, link)
        out[link] = path
    return out


def read_images(spark: SparkSession, paths: Sequence[str], first_id: int = 0, hash_fn: ImageHash = perceptual_hash) -> DataFrame:
    """MAPPED_IMAGE rows of the listed files that can be decoded; ids follow the list from
    first_id on. A path that is listed twice (a link and its target) gives two rows."""
    if not paths:
        return spark.createDataFrame([], MAPPED_IMAGE)
    listed = spark.createDataFrame([(first_id + i, p) for i, p in enumerate(paths)], "id long, physical_path string")
    small_batches(spark)
    alias = visible(spark, sorted(set(paths)))
    unique = [re.sub(r"([\\{}\[\]*?^])", r"\\\1", p) for p in alias]  # no globs
    parts = [spark.read.format("image").option("dropInvalid", True).load([f"file://{p}" for p in unique[i : i + PATHS_AT_ONCE]]) for i in range(0, len(unique), PATHS_AT_ONCE)]
    # The path comes back as an encoded URI, in which a plus sign stands for itself.
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    read = [p.select("image", path.alias("physical_path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("last_write_time")) for p in parts]
    images = read[0]
    for p in read[1:]:
        images = images.unionByName(p)
    renamed = {a: p for a, p in alias.items() if a != p}
    if renamed:
        real = spark.createDataFrame(list(renamed.items()), "physical_path string, _real string")
        images = images.join(real, "physical_path", "left").withColumn("physical_path", F.coalesce("_real", "physical_path")).drop("_real")
    seen = images.select("physical_path", looked_at(F.col("image"), hash_fn).alias("_seen"), "size", (F.col("image.width").cast("long") * F.col("image.height")).alias("resolution"), "last_write_time")
    mapped = seen.select("physical_path", "_seen.hash", "size", "resolution", "last_write_time", "_seen.is_grayscale")
    return listed.join(mapped, "physical_path").select(*COLUMNS)


def scan_folder(spark: SparkSession, folder: str, recursive: bool = False, extensions: Sequence[str] = DEFAULT_EXTENSIONS, links: bool = False, first_id: int = 0, hash_fn: ImageHash = perceptual_hash) -> DataFrame:
    """The images of a folder."""
    return read_images(spark, list_files(folder, recursive, extensions, links), first_id, hash_fn)


def scan_list(spark: SparkSession, paths: Sequence[str], hash_fn: ImageHash = perceptual_hash) -> DataFrame:
    """The images at the paths, ids in their order; a missing file is an error."""
    absolute = [os.path.abspath(p) for p in paths]
    missing = [p for p in absolute if not os.path.isfile(p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return read_images(spark, absolute, 0, hash_fn)
