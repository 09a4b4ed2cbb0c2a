import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold.functions.similarity import max_distance
from nearfold.operators import edges, groups, keep, matches, meetings
from nearfold.operators.components import components
from nearfold.schema import MAPPED_IMAGE


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashes(seed, n=60):
    """Random hashes, near ones of them, and extreme ones."""
    rng = random.Random(seed)
    out = [0, -1, 1 << 62, signed(1 << 63)]
    while len(out) < n:
        h = rng.getrandbits(64)
        out.append(signed(h))
        for _ in range(rng.randint(0, 4)):
            for _ in range(rng.randint(1, 9)):
                h ^= 1 << rng.randrange(64)
            out.append(signed(h))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 4, 6, 10, 20])
def test_blocked_join_equals_all_pairs(spark, k):
    mine, other = hashes(k), hashes(k)[::2] + hashes(k + 100)
    a = spark.createDataFrame([(h,) for h in mine], "hash long")
    b = spark.createDataFrame([(h,) for h in dict.fromkeys(other)], "hash long")
    want = {(x, y, distance(x, y)) for x in mine for y in mine if x < y and distance(x, y) <= k}
    got = [tuple(r) for r in edges.close_hashes(a, None, k).collect()]
    assert sorted(got) == sorted(want)
    want = {(x, y, distance(x, y)) for x in mine for y in other if distance(x, y) <= k}
    assert sorted(tuple(r) for r in edges.close_hashes(a, b, k, rows=10**9 if k < 6 else None).collect()) == sorted(want)


def test_blocks_grow_with_the_number_of_hashes():
    assert edges.choose_blocks(3, 1000).bits() < edges.choose_blocks(3, 10**10).bits()
    assert edges.choose_blocks(3, 10**10).bits() > 30
    for k in range(0, 64):
        blocks = edges.choose_blocks(k, 10**6)
        assert blocks.b - blocks.kept == k or blocks.kept == 1
        assert sum(blocks.masks()) == 2**64 - 1
    with pytest.raises(ValueError):
        edges.close_hashes(None, None, 64)


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    for n, m in ((30, 20), (40, 60), (25, 0)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        out = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        assert out == {i: find(i) for a, b in pairs if a != b for i in (a, b)}


DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def images(spark, rows):
    """rows: (id, hash[, size, resolution, day, gray])."""
    full = [(i, f"/p/{i:03d}.png", h, *(more or (1, 1, 0, False))[:2], DAY + dt.timedelta(days=(more or (0, 0, 0))[2]), (more or (0, 0, 0, False))[3]) for i, h, *more in rows]
    return spark.createDataFrame(full, MAPPED_IMAGE)


def test_groups_are_transitive(spark):
    chain = [(i, (1 << (3 * i)) - 1) for i in range(8)] + [(100, -1), (101, -1), (102, signed(0xF0F0 << 40))]
    table = images(spark, chain)
    out = {r["id"]: (r["component_id"], r["group_size"]) for r in groups.group_images(table, 96).collect()}
    assert out == {i: (0, 8) for i in range(8)} | {100: (100, 2), 101: (100, 2)}
    assert len(groups.group_images(table, 96, keep_singletons=True).collect()) == 11
    assert {r["id"] for r in groups.group_images(table, 100).collect()} == {100, 101}
    assert groups.group_images(table, 101).count() == 0 and groups.group_images(table, 101, True).count() == 11
    assert {r["component_id"] for r in groups.group_images(table, 0).collect()} == {0}
    assert groups.group_images(table.limit(0), 96).count() == 0


def test_edges_and_histogram_without_redundant_pairs(spark):
    table = images(spark, [(5, 7), (3, 7), (9, 7), (4, 6), (8, -1)])
    assert sorted(tuple(r) for r in edges.similarity_edges(table, 3).collect()) == [(3, 4, 1), (3, 5, 0), (3, 9, 0)]
    assert edges.similarity_edges(table, -1).count() == 0
    assert sorted(tuple(r) for r in edges.distance_histogram(table, 3).collect()) == [(0, 3), (1, 3)]


@pytest.mark.parametrize(
    ("preference", "best"),
    [("Newest", 2), ("Oldest", 3), ("Largest", 1), ("Smallest", 4), ("HighestResolution", 3), ("LowestResolution", 2), ("GrayScale", 4), ("Colorful", 1)],
)
def test_preferences(spark, preference, best):
    table = images(spark, [(1, 5, 90, 50, 5, False), (2, 5, 50, 10, 9, False), (3, 5, 60, 99, 1, False), (4, 5, 10, 20, 4, True)])
    grouped = groups.group_images(table, 96)
    assert [r["id"] for r in keep.best_of_groups(grouped, [preference]).collect()] == [best]
    assert [r["id"] for r in keep.best_of_groups(grouped, [preference.lower(), "Largest"]).collect()] == [best]


def test_ties_go_to_the_lesser_path_and_bad_preferences_are_errors(spark):
    table = images(spark, [(9, 5), (4, 5), (6, 5)])
    assert keep.best_of_groups(groups.group_images(table, 96)).first()["id"] == 4
    with pytest.raises(ValueError):
        keep.preferences([])
    with pytest.raises(ValueError):
        keep.preferences(["Best"])


def test_matches(spark):
    mine = images(spark, [(1, 0), (2, 0xFF), (3, signed(0xFFFF << 40))])
    other = images(spark, [(11, 1), (12, 3), (13, 1), (14, 0xFF)])
    out = {r["id"]: (r["match_id"], r["match_distance"]) for r in matches.nearest_match(mine, other, 96).collect()}
    assert out == {1: (11, 1), 2: (14, 0), 3: (None, None)}
    assert [r["id"] for r in matches.without_match(mine, other, 96).collect()] == [3]
    assert sorted(r["id"] for r in matches.with_match(mine, other, 96).collect()) == [1, 2]
    assert matches.without_match(mine, other, 101).count() == 3
    assert max_distance(96) == 3


def clumped(seed, n):
    """Distinct hashes around a few centres, so that many share every block."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    flips = sum(np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64) for _ in range(3))
    return [signed(int(h)) for h in np.unique(rng.choice(centres, n) ^ flips)]


def brute(table, k):
    x = np.array(table, np.int64).view(np.uint64)
    d = np.bitwise_count(x[:, None] ^ x)
    return [(int(i), int(j), int(d[i, j])) for i, j in zip(*np.nonzero(np.triu(d <= k, 1)), strict=True)]


@pytest.mark.parametrize("hot", [meetings.HOT, 40])
def test_clumped_hashes_and_hot_keys_lose_and_repeat_no_pair(spark, monkeypatch, hot):
    table = clumped(3, 600)
    want = sorted(brute(table, 6))
    blocks = edges.choose_blocks(6, len(table))
    frame = spark.createDataFrame([(h, i) for i, h in enumerate(table)], "hash long, value long")
    masks = blocks.masks()
    earlier = [[masks[i] for i in range(max(c)) if i not in c] for c in blocks.choices()]
    rows = edges.filed(frame, "hash", blocks)
    assert len(want) > 5000 and sorted(tuple(r) for r in meetings.met(rows, earlier, 6, len(table), meetings.LISTED, hot).collect()) == want
    monkeypatch.setattr(meetings, "BATCH", 100)
    monkeypatch.setattr(meetings, "CELLS", 500)
    batches = meetings.dealt(rows, len(table), len(earlier), hot).orderBy("choice", "key", "cell").toArrow().to_batches(max_chunksize=37)
    found = [(*sorted((int(a), int(b))), distance(int(x), int(y))) for p in meetings.meetings(batches, earlier, 6) for x, y, a, b in zip(*p, strict=True)]
    assert sorted(found) == want
    weights = {r["dist"]: r["w"] for r in meetings.met(rows, earlier, 6, len(table), meetings.WEIGHED, hot).groupBy("dist").agg(F.sum("w").alias("w")).collect()}
    assert weights == {d: sum(i * j for i, j, e in want if e == d) for d in {e for _, _, e in want}}


def test_edges_and_histogram_join_no_pairs(spark):
    """What a pair stands for travels with its hashes: pairs are not dealt out again to be named."""
    table = images(spark, [(i, h) for i, h in enumerate(clumped(4, 200))])
    for frame in (edges.similarity_edges(table, 6), edges.distance_histogram(table, 6)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "hash_a" not in plan and "MapInArrow" in plan


def test_stars_reach_what_the_edges_reach():
    rng = np.random.default_rng(5)
    for n, m in ((30, 20), (400, 380), (5, 0)):
        a, b = rng.integers(-n, n, m), rng.integers(-n, n, m)
        root = {int(x): int(x) for x in np.concatenate([a, b])}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            lo, hi = sorted((find(x), find(y)))
            root[hi] = lo
        assert sorted(zip(*(x.tolist() for x in meetings.stars(a, b)), strict=True)) == sorted((find(i), i) for i in root if find(i) != i)


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_tasks_hand_on_fewer_edges_than_pairs(most):
    table = clumped(6, 300)
    pairs = brute(table, 6)
    a, b = (np.array([p[i] for p in pairs]) for i in (0, 1))
    cut = range(0, len(a), 20)
    out = pa.Table.from_batches(meetings.spanned(((a[i : i + 20], b[i : i + 20], a[i : i + 20], b[i : i + 20]) for i in cut), most))
    whole, told = (sorted(zip(*(x.tolist() for x in meetings.stars(*e)), strict=True)) for e in ((a, b), (out["a"].to_numpy(), out["b"].to_numpy())))
    assert told == whole
    assert len(out) < len(table) < len(pairs)


def test_groups_of_clumped_hashes_hand_on_no_list_of_pairs(spark, monkeypatch):
    table = clumped(7, 400)
    sent = []
    real = groups.components
    monkeypatch.setattr(groups, "components", lambda e: (sent.append(e.count()), real(e))[1])
    out = {r["id"]: r["component_id"] for r in groups.group_images(images(spark, list(enumerate(table))), 90).collect()}
    pairs = brute(table, 6)
    a, b = (np.array([p[i] for p in pairs]) for i in (0, 1))
    root, node = (x.tolist() for x in meetings.stars(a, b))
    assert out == dict(zip(node, root, strict=True)) | {r: r for r in root}
    assert sent[0] < len(pairs) / 2
