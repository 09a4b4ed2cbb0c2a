"""Exact Hamming joins.

Two hashes at distance k or less, cut into b > k blocks, agree on b - k blocks at least.
So every hash is filed under each choice of b - k blocks, and hashes that meet under a key
are compared: this loses no pair. b follows the number of hashes: the more
there are, the longer the keys, so that a key holds few of them at any size.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.similarity import BITS, hamming
from nearfold.operators.meetings import LISTED, WEIGHED, met
from nearfold.tables import stored


@dataclass(frozen=True)
class Blocks:
    """b blocks of BITS bits, of which `kept` agree for sure."""

    b: int
    kept: int

    def masks(self) -> list[int]:
        edges = [BITS * i // self.b for i in range(self.b + 1)]
        return [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]

    def choices(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.b), self.kept))

    def bits(self) -> float:
        return BITS * self.kept / self.b


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def choose_blocks(k: int, rows: int) -> Blocks:
    """The blocks of least work for so many evenly spread hashes: rows to file, and pairs
    that meet under a key."""
    options = [Blocks(b, b - k) for b in range(k + 1, min(BITS, k + 6) + 1) if math.comb(b, k) <= 400]
    if not options:
        options = [Blocks(min(BITS, k + 1), 1)]
    return min(options, key=lambda o: len(o.choices()) * (2.0 * rows + rows * rows / 2 / 2 ** o.bits()))


def filed(frame: DataFrame, hash_: str, blocks: Blocks) -> DataFrame:
    """frame with a row for each choice: choice, key (the hash with all else blanked)."""
    masks = blocks.masks()
    joint = [signed(sum(masks[i] for i in c)) for c in blocks.choices()]
    choice = F.posexplode(F.array(*(F.lit(m) for m in joint))).alias("choice", "mask")
    return frame.select("*", choice).withColumn("key", F.col(hash_).bitwiseAND(F.col("mask"))).drop("mask")


def first_choice(difference: Column, blocks: Blocks) -> Column:
    """The first choice whose blocks all agree; every pair is reported there only."""
    masks = blocks.masks()
    joint = [signed(sum(masks[i] for i in c)) for c in blocks.choices()]
    return F.array_position(F.transform(F.array(*(F.lit(m) for m in joint)), lambda m: difference.bitwiseAND(m) == 0), True) - 1


def close_values(frame: DataFrame, k: int, become: tuple[Callable, str], hashes: int | None = None) -> DataFrame:
    """What `become` (LISTED, WEIGHED, SPANNED) makes of the pairs of distinct hashes at
    distance k or less. frame: hash, without repetitions, and value, a long that goes with
    it to wherever the hash is compared, so that pairs need no join with what they stand for."""
    if not 0 <= k < BITS:
        raise ValueError("k must lie between 0 and 63")
    frame = frame.where("hash is not null")
    hashes = frame.count() if hashes is None else hashes
    blocks = choose_blocks(k, hashes)
    masks = blocks.masks()
    earlier = [[masks[i] for i in range(max(c)) if i not in c] for c in blocks.choices()]
    return met(filed(frame, "hash", blocks), earlier, k, hashes, become)


def close_hashes(left: DataFrame, right: DataFrame | None, k: int, rows: int | None = None) -> DataFrame:
    """hash_a, hash_b, dist of all pairs of distinct hashes at distance k or less: of one
    frame with hash_a < hash_b, or of two frames, equal hashes included. Both frames have
    one column, hash, without repetitions. k from 0 to 63."""
    if not 0 <= k < BITS:
        raise ValueError("k must lie between 0 and 63")
    if right is None:
        return close_values(left.select("hash", F.col("hash").alias("value")), k, LISTED, rows).toDF("hash_a", "hash_b", "dist")
    blocks = choose_blocks(k, left.count() if rows is None else rows)
    a = filed(left.select(F.col("hash").alias("hash_a")), "hash_a", blocks)
    b = filed(right.select(F.col("hash").alias("hash_b")), "hash_b", blocks)
    both = a.join(b, ["choice", "key"]).where(hamming(F.col("hash_a"), F.col("hash_b")) <= k)
    difference = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    once = both.where(F.col("choice") == first_choice(difference, blocks))
    return once.select("hash_a", "hash_b", hamming(F.col("hash_a"), F.col("hash_b")).cast("int").alias("dist"))


def similarity_edges(images: DataFrame, k: int) -> DataFrame:
    """src_id, dst_id, dist: the similarity graph without redundant pairs. Each distinct
    hash is represented by its least id, linked with every other holder of the hash at
    distance 0 and with the representatives of the hashes at distance k or less."""
    reps = images.groupBy("hash").agg(F.min("id").alias("rep"))
    if k >= 0:
        reps = stored(reps, "hashes")  # read by every join below
    if k < 0:
        return reps.where("false").select(F.col("rep").alias("src_id"), F.col("rep").alias("dst_id"), F.lit(0).alias("dist"))
    # A hash held by a third of all images is a hot key of this join only, where the
    # adaptive skew join splits it.
    same = images.join(reps, "hash").where("id <> rep").select(F.col("rep").alias("src_id"), F.col("id").alias("dst_id"), F.lit(0).alias("dist"))
    if k == 0:
        return same
    pairs = close_values(reps.select("hash", F.col("rep").alias("value")), min(k, BITS - 1), LISTED)
    return same.unionByName(pairs.toDF("src_id", "dst_id", "dist"))


def distance_histogram(images: DataFrame, k: int) -> DataFrame:
    """dist, pairs: unordered pairs of images by distance, up to k; copies count as the
    pairs that they make, without making them."""
    holders = stored(images.groupBy("hash").agg(F.count("*").alias("n")), "hashes")
    same = holders.where("n > 1").select(F.lit(0).alias("dist"), F.expr("n * (n - 1) div 2").alias("w"))
    near = close_values(holders.select("hash", F.col("n").alias("value")), k, WEIGHED)
    return same.unionByName(near).groupBy("dist").agg(F.sum("w").alias("pairs"))
