"""A 64-bit SimHash of texts: a signature that puts tables of documents in the place of
folders of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def simhash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, hash: every bit is the sign of the sum over the tokens (split at single
    spaces, lower-cased) of that bit of the first 64 bits of their md5."""
    token = F.explode(F.split(F.lower(text), " ")).alias("token")
    halves = docs.select(key, token).select(key, F.md5(F.col("token").cast("binary")).alias("m"))

    def half(at: int):
        return F.conv(F.substring("m", at, 8), 16, 10).cast("long")

    hashed = halves.select(key, F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("h"))
    # Two counters of 32 bits in each sum: how many tokens have bit i, and bit i + 32.
    both = F.lit((1 << 32) | 1)
    votes = hashed.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(both)).alias(f"s{i}") for i in range(32)))
    bits = F.lit(0).cast("long")
    for i in range(32):
        for at, ones in ((i, F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1))), (i + 32, F.shiftrightunsigned(f"s{i}", 32))):
            bits = bits.bitwiseOR(F.shiftleft((2 * ones > F.col("n")).cast("long"), at))
    return votes.select(key, bits.alias("hash"))
