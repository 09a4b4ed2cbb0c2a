"""Exact top-k search by inner product: ball trees, branch and bound.

Vectors are indexed where they are read, in shards of at most `shard_rows`, each with a
ball tree that is built once and stored with it. Queries go in blocks of a fixed size past
the shards, which stay where they are: a block is broadcast, every task searches its shards
for it and returns k rows a query. Every query opens its node of the highest upper bound
(q.c + |q| r) first and drops nodes, and whole shards by their root's bound, that cannot
beat its current k-th score. That score is shared: a first shard answers the block, the
k-th scores it leaves bound the search of all others, and within a task each shard starts
from the last one's.

Scores are exact integers. Products are made in float64 where they stay below 2**53, in
64-bit integers below 2**63 and in Python's integers above; vectors are put into shards and
blocks by the size of their components, so that a few large ones slow no others down.
Scores beyond the range of a long are returned as its end. Ties go to the lesser id. A
query's own rows (those with its id) are no candidates. Rows with a null id or an unusable
vector (null, or with a null component) take no part; vectors meet vectors of their own
length only. Repeated query rows are answered each; repeated candidate rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.common import dropped, give_back, small_batches, stored

LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

#: Bytes of the vectors of a shard or block at most, but for one vector.
SHARD_BYTES = 16 << 20

#: Components of less than so many bits are put together.
BITS = (20, 31, 64)

SHARD = "no string, dim int, bits int, n long, ids binary, vectors binary, nodes binary, balls binary"
SHARD_ARROW = pa.schema([("no", pa.string()), ("dim", pa.int32()), ("bits", pa.int32()), ("n", pa.int64()), *((x, pa.binary()) for x in ("ids", "vectors", "nodes", "balls"))])


def build(vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = 128):
    """Permutation and nodes (first row, end, left child, right child or -1, least id),
    centres, radii."""
    order = np.arange(len(ids))
    nodes, centres, radii = [], [], []
    todo = [(0, len(ids), -1)]
    while todo:
        a, b, parent = todo.pop()
        rows = order[a:b]
        part = vectors[rows]
        centre = part.mean(axis=0)
        away = np.sqrt(((part - centre) ** 2).sum(axis=1))
        me = len(nodes)
        nodes.append([a, b, -1, -1, int(ids[rows].min())])
        centres.append(centre)
        radii.append(away.max())
        if parent >= 0:
            nodes[parent][2 if nodes[parent][2] < 0 else 3] = me
        if b - a > leaf_rows and away.max() > 0:
            one = part[away.argmax()]
            two = part[((part - one) ** 2).sum(axis=1).argmax()]
            along = part @ (two - one)
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(along, half)]
            todo += [(a, a + half, me), (a + half, b, me)]
    return order, np.array(nodes, dtype=np.int64), np.array(centres), np.array(radii)


@dataclass
class Shard:
    """Vectors in the order of their tree."""

    ids: np.ndarray
    vectors: np.ndarray
    nodes: np.ndarray
    centres: np.ndarray
    radii: np.ndarray

    @classmethod
    def of(cls, vectors: np.ndarray, ids: np.ndarray, leaf_rows: int = 128) -> Shard:
        order, nodes, centres, radii = build(vectors.astype(np.float64), ids, leaf_rows)
        return cls(ids[order], vectors[order], nodes, centres, radii)

    @classmethod
    def read(cls, row: dict) -> Shard:
        balls = np.frombuffer(row["balls"], np.float64).reshape(-1, row["dim"] + 1)
        return cls(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["dim"]), np.frombuffer(row["nodes"], np.int64).reshape(-1, 5), balls[:, :-1], balls[:, -1])

    def written(self) -> dict:
        return {"ids": self.ids.tobytes(), "vectors": self.vectors.astype(np.int64).tobytes(), "nodes": self.nodes.tobytes(), "balls": np.column_stack((self.centres, self.radii)).tobytes()}


class Best:
    """The k best candidates of each query so far, and the score that others share."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None, floor_id: np.ndarray | None = None) -> None:
        self.score = np.full((n, k), LOWEST)
        self.id = np.full((n, k), HIGHEST)
        self.some = np.zeros((n, k), bool)
        self.floor = np.full(n, LOWEST) if floor is None else floor
        self.floor_id = np.full(n, HIGHEST) if floor_id is None else floor_id

    def kth(self) -> tuple[np.ndarray, np.ndarray]:
        """The score to beat and, for equals, the id to go below."""
        own = (self.score[:, -1] > self.floor) | ((self.score[:, -1] == self.floor) & (self.id[:, -1] < self.floor_id))
        return np.where(own, self.score[:, -1], self.floor), np.where(own, self.id[:, -1], self.floor_id)

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """scores (queries, candidates) of the candidates `ids` that fit."""
        k = self.score.shape[1]
        if scores.shape[1] > k:  # what k others of the same offer beat is out
            shown = np.where(fit, scores, LOWEST)
            fit = fit & (shown >= np.partition(shown, -k, axis=1)[:, -k, None])
        (r, c), (r0, c0) = np.nonzero(fit), np.nonzero(self.some[q])
        row = np.concatenate((r, r0))
        score, id_ = np.concatenate((scores[r, c], self.score[q[r0], c0])), np.concatenate((ids[c], self.id[q[r0], c0]))
        turn = np.lexsort((id_, ~score, row))
        row, score, id_ = row[turn], score[turn], id_[turn]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, score, id_, place = (x[place < k] for x in (row, score, id_, place))
        self.score[q], self.id[q], self.some[q] = LOWEST, HIGHEST, False
        self.score[q[row], place], self.id[q[row], place], self.some[q[row], place] = score, id_, True


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, ends of a long beyond its range."""
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (queries, vectors)]
    bound = queries.shape[1] * most[0] * most[1]
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    wide = queries.astype(np.int64).astype(object) @ vectors.astype(np.int64).astype(object).T
    return np.clip(wide, LOWEST, HIGHEST).astype(np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, shard: Shard, best: Best) -> int:
    """Branch and bound over one shard for a block of queries; returns the leaves opened."""
    asked = queries.astype(np.float64)
    if len(queries) and queries.shape[1] * max(float(np.abs(asked).max()), 1.0) * max(float(np.abs(shard.vectors.astype(np.float64)).max(initial=0)), 1.0) < 1 << 53:
        queries, vectors = asked, shard.vectors.astype(np.float64)  # once, not for each leaf
    else:
        vectors = shard.vectors
    nodes, ids = shard.nodes, shard.ids
    norms = np.sqrt((asked**2).sum(axis=1))
    reach = np.sqrt((shard.centres**2).sum(axis=1)) + shard.radii
    bound = asked @ shard.centres.T + norms[:, None] * shard.radii[None, :]
    bound = bound + 1e-9 * norms[:, None] * reach[None, :] + 1e-6  # more than rounding can take away
    bound = np.maximum(bound, float(LOWEST))
    open_ = np.full(bound.shape, -np.inf)
    open_[:, 0] = bound[:, 0]
    score, least = best.kth()
    alive, opened = np.flatnonzero(bound[:, 0] >= score), 0
    while len(alive):
        node = open_[alive].argmax(axis=1)
        top = open_[alive, node]
        score, least = best.kth()
        score, least = score[alive], least[alive]
        # Equal bounds are met only where an id below the k-th one may lie. Other open
        # nodes of that bound may still hold one, so only lower bounds end a query.
        going = top >= score
        worth = (np.floor(top) > score) | (nodes[node, 4] < least)
        alive, node, worth = alive[going], node[going], worth[going]
        open_[alive, node] = -np.inf
        inner = worth & (nodes[node, 2] >= 0)
        for child in (2, 3):
            q, c = alive[inner], nodes[node[inner], child]
            open_[q, c] = np.minimum(bound[q, c], bound[q, node[inner]])
        leaf = worth & (nodes[node, 2] < 0)
        who, where = alive[leaf], node[leaf]
        turn = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[turn])) + 1
        for group in np.split(turn, cuts) if len(turn) else ():
            qs, (a, b) = who[group], nodes[where[group[0]], :2]
            opened += 1
            scores = (queries[qs] @ vectors[a:b].T).astype(np.int64) if vectors.dtype == np.float64 else products(queries[qs], vectors[a:b])
            score, _ = best.kth()
            fit = (scores >= score[qs][:, None]) & (ids[a:b][None, :] != query_ids[qs][:, None])
            hit = np.flatnonzero(fit.any(axis=1))
            if len(hit):
                some = fit[hit].any(axis=0)
                best.offer(qs[hit], scores[np.ix_(hit, some)], ids[a:b][some], fit[np.ix_(hit, some)])
        open_rows = open_[alive].max(axis=1) > -np.inf if len(alive) else np.zeros(0, bool)
        alive = alive[open_rows]
    return opened


def packed(frame: DataFrame, rows: int, leaf_rows: int | None = None) -> DataFrame:
    """(id, vec array<long>) as SHARD rows of at most `rows` vectors of one length and size
    of components, cut from the stream: no shuffle, and no value of any column can make one
    larger. With trees, if leaf_rows is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, int], list] = {}

        def out(key: tuple[int, int]) -> pa.RecordBatch:
            nonlocal made
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            made += 1
            index = Shard.of(vecs, ids, leaf_rows).written() if leaf_rows else {"ids": ids.tobytes(), "vectors": vecs.tobytes(), "nodes": None, "balls": None}
            return pa.RecordBatch.from_pylist([{"no": f"{part:08d}-{made:08d}", "dim": key[0], "bits": key[1], "n": len(ids), **index}], schema=SHARD_ARROW)

        for b in batches:
            ids, vecs = b.column("id").to_numpy(zero_copy_only=False), b.column("vec")
            sizes = np.diff(vecs.offsets.to_numpy())
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                mat = flat[starts[mine][:, None] + np.arange(dim)[None, :]].reshape(len(mine), dim).astype(np.int64)
                large = np.maximum(mat, ~mat).max(axis=1, initial=0)
                bits = np.array(BITS)[np.searchsorted(np.array([1 << x for x in BITS[:-1]]), large, side="right")]
                for size in np.unique(bits):
                    key, some = (int(dim), int(size)), np.flatnonzero(bits == size)
                    most = max(1, min(rows, SHARD_BYTES // max(1, 8 * int(dim))))
                    for at in range(0, len(some), most):
                        now = some[at : at + most]
                        have = sum(len(x) for x, _ in held.get(key, ()))
                        if have and have + len(now) > most:
                            yield out(key)
                        held.setdefault(key, []).append((ids[mine[now]].astype(np.int64), mat[now]))
        for key in list(held):
            yield out(key)
        give_back()

    return frame.mapInArrow(run, SHARD)


ANSWER = "block string, place int, query_id long, id long, score long"


def asked_of(block: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(block["ids"], np.int64)
    return ids, np.frombuffer(block["vectors"], np.int64).reshape(len(ids), block["dim"])


def answer(block: dict, best: Best) -> pa.RecordBatch:
    place, rank = np.nonzero(best.some)
    ids, _ = asked_of(block)
    return pa.RecordBatch.from_arrays([pa.array([block["no"]] * len(place), pa.string()), pa.array(place.astype(np.int32)), pa.array(ids[place]), pa.array(best.id[place, rank]), pa.array(best.score[place, rank])], names=["block", "place", "query_id", "id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, block_rows: int = 4096, blocks_at_once: int = 4, leaf_rows: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.
    Both frames: id long, vec array<long>. blocks_at_once: blocks of block_rows queries that
    are broadcast together, which bounds what is sent at once by blocks_at_once * SHARD_BYTES;
    the shards are read once for each such set."""
    if k < 1:
        raise ValueError("k must be positive")
    small_batches(candidates.sparkSession)
    spark = candidates.sparkSession
    usable = "id is not null and vec is not null and not exists(vec, x -> x is null)"
    shards = stored(packed(candidates.select("id", "vec").where(usable), shard_rows, leaf_rows), "shards")
    asked = stored(packed(queries.select("id", "vec").where(usable), block_rows), "queries")
    names = [r["no"] for r in asked.select("no").orderBy("dim", "no").collect()]  # one name for thousands of queries
    # The largest shard of each length answers first.
    first = {r["dim"]: r["no"] for r in shards.groupBy("dim").agg(F.max(F.struct("n", "no"))["no"].alias("no")).collect()}  # one for each length of vectors
    made, wide = shards.count(), spark.sparkContext.defaultParallelism
    if 1 < made <= 4 * wide:  # few shards, cut by few tasks: one for each core
        before, shards = shards, stored(shards.repartition(min(made, wide), "no"), "shards")
        dropped(before)
    out = None
    for at in range(0, len(names), blocks_at_once):
        found = search_blocks(spark, shards, asked.where(F.col("no").isin(names[at : at + blocks_at_once])), first, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], ANSWER)
    by_score = Window.partitionBy("block", "place").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def search_blocks(spark, shards: DataFrame, asked: DataFrame, first: dict[int, str], k: int) -> DataFrame:
    """ANSWER rows of a few blocks, which the driver holds, from all shards; stored."""
    blocks = [{**r.asDict(), "ids": bytes(r["ids"]), "vectors": bytes(r["vectors"])} for r in asked.collect()]
    sent = spark.sparkContext.broadcast(blocks)

    def search_all(batches: Iterator[pa.RecordBatch], floors: dict, done: set) -> Iterator[pa.RecordBatch]:
        best: dict[str, Best] = {}
        for b in batches:
            for row in b.to_pylist():
                for q in sent.value if row["no"] not in done else ():
                    if q["dim"] == row["dim"]:
                        ids, vectors = asked_of(q)
                        if q["no"] not in best:
                            best[q["no"]] = Best(len(ids), k, *floors.get(q["no"], ()))
                        search(vectors, ids, Shard.read(row), best[q["no"]])
        yield from (answer(q, best[q["no"]]) for q in sent.value if q["no"] in best)
        give_back()

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search_all(batches, {}, set())

    dims = {q["dim"] for q in blocks}
    seeds = stored(shards.where(F.col("no").isin([no for dim, no in first.items() if dim in dims])).mapInArrow(seed, ANSWER), "seeds")
    floors: dict[str, list] = {q["no"]: [np.full(len(q["ids"]) // 8, LOWEST), np.full(len(q["ids"]) // 8, HIGHEST)] for q in blocks}
    kth = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "id"))
    for r in seeds.withColumn("r", kth).where(F.col("r") == k).select("block", "place", "score", "id").collect():  # one a query of these blocks
        floors[r["block"]][0][r["place"]], floors[r["block"]][1][r["place"]] = r["score"], r["id"]
    shared, done = spark.sparkContext.broadcast(floors), set(first.values())

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from search_all(batches, shared.value, done)

    found = stored(seeds.unionByName(shards.mapInArrow(rest, ANSWER)), "found")
    dropped(seeds)
    sent.unpersist()
    shared.unpersist()
    return found


def quantised(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256) -> DataFrame:
    """id and vec: floor(factor * x) of every component as a double (the ends of a long
    beyond its range); null vectors for those that are null or hold a null or non-finite
    component."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return frame.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(vec, lambda x: F.floor(F.lit(factor) * x))).alias("vec"))
