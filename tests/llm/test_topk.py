import numpy as np
import pytest
from nearfold.llm import topk


def brute(rows, queries, k):
    out = []
    for qi, q in queries:
        found = sorted((-sum(int(a) * int(b) for a, b in zip(q, v)), i) for i, v in rows if i != qi and len(v) == len(q))
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, [int(x) for x in v]) for i, v in rows], "id long, vec array<long>")


@pytest.mark.parametrize("spread", [300, 2])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-spread, spread + 1, 6)) for i in range(700)] + [(700 + i, np.full(6, 2)) for i in range(200)]
    queries = [r for r in rows if r[0] % 50 == 0]
    got = topk.top_k(frame(spark, rows).repartition(3), frame(spark, queries), 5, shard_rows=90, block_rows=7, blocks_at_once=2, leaf_rows=8)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, queries, 5)


def test_pruning_opens_few_leaves_and_loses_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 4000, (40, 8))
    vectors = np.round(np.repeat(centres, 100, axis=0) + rng.normal(0, 30, (4000, 8)))
    ids = rng.permutation(4000)
    best = topk.Best(20, 5)
    opened = topk.search(vectors[:20], ids[:20], topk.Shard.of(vectors.astype(np.int64), ids, 50), best)
    scores = (vectors[:20] @ vectors.T).astype(np.int64)
    for q in range(20):
        keep = ids != ids[q]
        order = np.lexsort((ids[keep], -scores[q][keep]))[:5]
        assert (best.score[q] == scores[q][keep][order]).all() and (best.id[q] == ids[keep][order]).all()
    assert opened < 20 * 80 / 4


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -0.001]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (None, [9.0, 9.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (5, [1.0]), (6, [float("inf"), 0.0]), (100, [2.0]), (150, [3.0, 1.0, 4.0]), (200, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, VEC string")
    q = topk.quantised(table)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = brute([(i, np.array(v)) for i, v in good], [(i, np.array(v)) for i, v in good if i % 50 == 0], 5)
    got = topk.top_k(q, q.where("id % 50 = 0"), 5, shard_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, b, c, d) for a, b, c, d in want)
    assert topk.top_k(q.limit(0), q.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [int(x) for x in rng.integers(-300, 300, 4)]) for i in range(120)]
    rows += [(200 + i, [int(x) for x in rng.integers(-(2**28), 2**28, 4)]) for i in range(60)]  # 64 bits hold the products
    rows += [(300, [2**40, -(2**41), 5, 7]), (350, [2**40 + 1, 3, -(2**39), 1]), (400, [2**62, 2**62, 2**62, -(2**63)]), (401, [-(2**62)] * 4)]
    queries = [r for r in rows if r[0] % 50 == 0]
    got = topk.top_k(frame(spark, rows).repartition(2), frame(spark, queries), 5, shard_rows=30, block_rows=4, leaf_rows=8)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())
    scores = {i: {j: min(max(sum(a * b for a, b in zip(v, w)), -(1 << 63)), (1 << 63) - 1) for j, w in rows if j != i} for i, v in queries}
    want = [(i, r + 1, j, s) for i, mine in scores.items() for r, (s, j) in enumerate(sorted(((s, j) for j, s in mine.items()), key=lambda x: (-x[0], x[1]))[:5])]
    assert got == sorted(want)


def test_large_floats_take_part(spark):
    table = spark.createDataFrame([(0, [1e5, 1.0]), (1, [100000.0, 2.0]), (2, [-3.0, 1.5]), (3, [3e38, 0.0])], "vec_id long, embedding array<float>")
    q = topk.quantised(table)
    got = [tuple(r) for r in topk.top_k(q, q.where("id % 50 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 3, (1 << 63) - 1), (0, 2, 1, 25_600_000**2 + 256 * 512), (0, 3, 2, -25_600_000 * 768 + 256 * 384)]


def test_trees_are_stored_with_their_shards():
    rng = np.random.default_rng(2)
    vectors, ids = rng.integers(-99, 99, (500, 3)), rng.permutation(500)
    made = topk.Shard.of(vectors, ids, 40)
    back = topk.Shard.read(made.written() | {"n": 500, "dim": 3})
    assert all(np.array_equal(getattr(made, x), getattr(back, x)) for x in ("ids", "vectors", "nodes", "centres", "radii"))
    assert {tuple(v) for v in back.vectors} == {tuple(v) for v in vectors}
