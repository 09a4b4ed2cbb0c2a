"""Hamming similarity of 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def max_distance(bar: int) -> int:
    """The largest distance that a similarity bar in per cent admits; below 0, nothing is
    similar, not even an image to itself."""
    return BITS - round(BITS * bar / 100)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ratio(distance: Column) -> Column:
    """Similarity from 0 to 1."""
    return (BITS - distance) / F.lit(float(BITS))


def hash_hex(hash_: Column) -> Column:
    """The hash as unsigned hexadecimal digits."""
    return F.hex(hash_)


def percent(ratio_: Column) -> Column:
    """A ratio as text with two decimals."""
    return F.concat(F.format_number(ratio_ * 100, 2), F.lit("%"))
