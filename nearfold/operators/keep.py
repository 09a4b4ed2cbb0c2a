"""Choosing the image to keep in each group."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Keep(str, Enum):
    """Preferences, each an order of one column."""

    NEWEST = "Newest"
    OLDEST = "Oldest"
    SMALLEST = "Smallest"
    LARGEST = "Largest"
    HIGHEST_RESOLUTION = "HighestResolution"
    LOWEST_RESOLUTION = "LowestResolution"
    GRAYSCALE = "GrayScale"
    COLORFUL = "Colorful"

    def order(self) -> Column:
        column, down = ORDERS[self]
        return F.desc(column) if down else F.asc(column)


#: column, descending
ORDERS = {
    Keep.NEWEST: ("last_write_time", True),
    Keep.OLDEST: ("last_write_time", False),
    Keep.LARGEST: ("size", True),
    Keep.SMALLEST: ("size", False),
    Keep.HIGHEST_RESOLUTION: ("resolution", True),
    Keep.LOWEST_RESOLUTION: ("resolution", False),
    Keep.GRAYSCALE: ("is_grayscale", True),
    Keep.COLORFUL: ("is_grayscale", False),
}

DEFAULT_KEEP = (Keep.COLORFUL, Keep.HIGHEST_RESOLUTION, Keep.LARGEST, Keep.NEWEST)


def preferences(names: Sequence[str | Keep]) -> list[Keep]:
    """Keep values by name, case ignored; at least one."""
    known = {k.value.lower(): k for k in Keep}
    out = []
    for name in names:
        value = name.value if isinstance(name, Keep) else str(name)
        if value.lower() not in known:
            raise ValueError(f"unknown preference {value!r}; one of {', '.join(k.value for k in Keep)}")
        out.append(known[value.lower()])
    if not out:
        raise ValueError("at least one preference is needed")
    return out


def best_of_groups(grouped: DataFrame, keep: Sequence[str | Keep] = DEFAULT_KEEP) -> DataFrame:
    """The first row of every group by the preferences, then path, then id. One row is
    kept of a group while it is read, so a large group costs one task no memory."""
    orders = [p.order() for p in preferences(keep)]
    w = Window.partitionBy("component_id").orderBy(*orders, "physical_path", "id")
    return grouped.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
