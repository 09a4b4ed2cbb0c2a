"""Near pairs of one set of hashes: those that meet under a key are compared by numpy.

Distances within a key cost about a nanosecond a pair. A key that more than HOT hashes
share is dealt out as cells, each with the pairs within one part of its members or between
two parts, so that no task grows with a key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a key, or of a part of it, that are compared in one task.
HOT = 16_384

#: Filed rows that a task gets on average.
TASK_ROWS = 200_000

#: Groups up to this size are compared all at once, shift by shift.
SMALL = 32

#: Entries of a matrix of distances, and pairs that are handed on at once.
CELLS = 1 << 18

#: Rows that are looked at together; a group that goes on waits for the rest of it.
BATCH = 1 << 16

#: A row's side: of a cell for all pairs, or one of the two of a cell for the pairs between.
WHOLE, ONE, TWO = 0, 1, 2

#: hash_a, hash_b, value_a, value_b.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def dealt(rows: DataFrame, hashes: int, choices: int, hot: int = HOT) -> DataFrame:
    """Filed rows (choice, key, hash, value) with cell and side; the members of a cell
    follow each other. hashes: how many there are, which no key exceeds."""
    cell_of = lambda cell, side: F.struct(cell.cast("long").alias("cell"), side.cast("byte").alias("side"))
    if hashes <= hot:
        out = rows.select("*", F.lit(0).cast("long").alias("cell"), F.lit(WHOLE).cast("byte").alias("side"))
    else:
        parts = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("choice", "key", F.ceil(F.col("n") / hot).alias("parts"))
        # At most one key for each `hot` filed rows.
        marked = rows.join(F.broadcast(parts), ["choice", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("hash"), "parts"))

        def meets(other):
            side = F.when(other == F.col("mine"), WHOLE).when(other > F.col("mine"), ONE).otherwise(TWO)
            return cell_of(F.least("mine", other) * F.col("parts") + F.greatest("mine", other), side)

        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), meets)
        out = marked.select(*rows.columns, F.inline(F.coalesce(cells, F.array(cell_of(F.lit(0), F.lit(WHOLE))))))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(hashes * choices / TASK_ROWS))
    return out.repartition(tasks, "choice", "key", "cell").sortWithinPartitions("choice", "key", "cell")


def compared(x: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of near members of the groups from starts to ends: two arrays, repeatedly."""
    sizes = ends - starts
    if small := int(sizes[sizes <= SMALL].max(initial=0)):
        left = np.where(np.repeat(sizes <= SMALL, sizes), np.repeat(ends, sizes) - 1 - np.arange(len(x)), 0)  # members behind each
        at = np.arange(len(x))
        for shift in range(1, small):
            at = at[left[at] >= shift]
            one, two = side[at], side[at + shift]
            near = (np.bitwise_count(x[at] ^ x[at + shift]) <= k) & ((one != two) | (one == WHOLE))
            yield at[near], at[near] + shift
    for start, end in zip(starts[sizes > SMALL].tolist(), ends[sizes > SMALL].tolist(), strict=True):
        if side[start] == WHOLE:
            step = max(1, CELLS // (end - start))
            for r in range(start, end - 1, step):
                rows, columns = x[r : r + step], x[r + 1 : end]
                flat = np.flatnonzero(np.bitwise_count(rows[:, None] ^ columns) <= k)
                row = flat // len(columns)
                column = flat - row * len(columns)
                later = column >= row
                yield r + row[later], r + 1 + column[later]
        else:
            ones, twos = (start + np.flatnonzero(side[start:end] == s) for s in (ONE, TWO))
            columns = x[twos]
            step = max(1, CELLS // max(1, len(twos)))
            for r in range(0, len(ones) if len(twos) else 0, step):
                flat = np.flatnonzero(np.bitwise_count(x[ones[r : r + step], None] ^ columns) <= k)
                row = flat // len(columns)
                yield ones[r + row], twos[flat - row * len(columns)]


def within_choice(x: np.ndarray, value: np.ndarray, side: np.ndarray, starts: np.ndarray, ends: np.ndarray, earlier: list[int], k: int) -> Iterator[Pairs]:
    """The near pairs of a choice's groups that are reported there: whose earlier blocks all differ."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0

    def told() -> Pairs:
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        for mask in earlier:
            new = ((x[a] ^ x[b]) & np.uint64(mask)) != 0
            a, b = a[new], b[new]
        return x[a].view(np.int64), x[b].view(np.int64), value[a], value[b]

    for found in compared(x, side, starts, ends, k):
        held.append(found)
        many += len(found[0])
        if many >= CELLS:
            yield told()
            held, many = [], 0
    if many:
        yield told()


def meetings(batches: Iterable[pa.RecordBatch], earlier: list[list[int]], k: int) -> Iterator[Pairs]:
    """Every near pair of a task's cells, at the first choice under which it meets.
    earlier: for each choice, the masks of the blocks before its last that it leaves out."""

    def groups(table: pa.Table, last: bool) -> tuple[list[Pairs], pa.Table]:
        """Pairs of the groups that are whole, and the rows of the last unless it is."""
        column = lambda name: table[name].to_numpy()
        choice, key, cell = (column(c) for c in ("choice", "key", "cell"))
        new = np.flatnonzero((choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(choice)] if last else []]).astype(np.int64)
        x, value, side = column("hash").view(np.uint64), column("value"), column("side")
        starts, ends = bounds[:-1], bounds[1:]

        def pairs():
            for c in np.unique(choice[starts]).tolist():
                mine = np.flatnonzero(choice[starts] == c)
                lo, hi = int(starts[mine[0]]), int(ends[mine[-1]])
                yield from within_choice(x[lo:hi], value[lo:hi], side[lo:hi], starts[mine] - lo, ends[mine] - lo, earlier[c], k)

        return pairs(), table.slice(int(bounds[-1]))

    held, many = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            many += batch.num_rows
        if many >= BATCH:
            pairs, rest = groups(pa.Table.from_batches(held), False)
            yield from pairs
            held = rest.combine_chunks().to_batches()
            many = 0  # so that a long group is not looked at for every batch of it
    if held:
        yield from groups(pa.Table.from_batches(held), True)[0]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int32)  # of a signed number it counts the absolute value's


def listed(pairs: Iterable[Pairs]) -> Iterator[pa.RecordBatch]:
    """a, b, dist: the values of each pair, the lesser first."""
    for ha, hb, va, vb in pairs:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(va, vb), np.maximum(va, vb), distances(ha, hb))], ["a", "b", "dist"])


def weighed(pairs: Iterable[Pairs]) -> Iterator[pa.RecordBatch]:
    """dist, w: the sum of the products of the values, by distance."""
    sums: dict[int, int] = {}
    for ha, hb, va, vb in pairs:
        dist, product = distances(ha, hb), va * vb
        for d in np.unique(dist).tolist():
            sums[d] = sums.get(d, 0) + int(product[dist == d].sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.int64())], ["dist", "w"])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node to the least that the edges (a, b) reach, without loops."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while len(one):
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
        one, two = root[one], root[two]
        apart = one != two
        one, two = one[apart], two[apart]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def spanned(pairs: Iterable[Pairs], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """a, b: an edge from each value to the least that the pairs of the task join it with,
    whatever the order of the pairs. most: pairs that are held until they are reduced."""
    held, many = [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        return stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))

    for _, _, va, vb in pairs:
        held.append((va, vb))
        many += len(va)
        if many >= most:
            held = [reduced()]
            many = len(held[0][0])
            most = max(most, 2 * many)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in reduced()], ["a", "b"])


#: What becomes of the pairs, and its columns.
LISTED: tuple[Callable, str] = (listed, "a long, b long, dist int")
WEIGHED: tuple[Callable, str] = (weighed, "dist int, w long")
SPANNED: tuple[Callable, str] = (spanned, "a long, b long")


def met(rows: DataFrame, earlier: list[list[int]], k: int, hashes: int, become: tuple[Callable, str], hot: int = HOT) -> DataFrame:
    """What `become` makes of the near pairs of filed rows (choice, key, hash, value)."""
    make, columns = become

    def run(batches):
        return make(meetings(batches, earlier, k))

    return dealt(rows.select("choice", "key", "hash", "value"), hashes, len(earlier), hot).mapInArrow(run, columns)
