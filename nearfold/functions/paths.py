"""Rules over path columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    wanted = [x.lstrip(".").lower() for x in extensions]
    return extension(path).isin(wanted) & F.rlike(path, F.lit(r"\.[^./]*$"))


def in_trash(path: Column) -> Column:
    """Whether the immediate folder's name ends with .trash; deeper ones do not count."""
    return F.endswith(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), F.lit(".trash"))


def under(root: str, path: Column, source_root: str) -> Column:
    """Where a file of source_root lies below root; by its name alone, if it lies outside
    source_root."""
    prefix = source_root.rstrip("/") + "/"
    inside = F.startswith(path, F.lit(prefix))
    below = F.when(inside, F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(file_name(path))
    return F.concat(F.lit(root.rstrip("/") + "/"), below)
