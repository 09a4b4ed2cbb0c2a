"""Filters over listings of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.paths import has_extension, in_trash


def without_trash(files: DataFrame, path: str = "physical_path") -> DataFrame:
    return files.where(~in_trash(F.col(path)))


def without_links(files: DataFrame, flag: str = "is_symlink") -> DataFrame:
    return files.where(~F.col(flag))


def with_extensions(files: DataFrame, extensions: Sequence[str], path: str = "physical_path") -> DataFrame:
    if not extensions:
        raise ValueError("at least one extension is needed")
    return files.where(has_extension(F.col(path), extensions))
