import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from nearfold.llm import jaccard as J
from nearfold.llm import shingles as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, size=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, num, den, size):
    """(id, set size, least id reached) of each row, as a sorted list."""
    sets = [grams(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    return sorted(((x, len(sets[i]), least.get(find(i))) for i, (x, _) in enumerate(rows)), key=key), key


def test_shingles_equal_plain_sets():
    texts = [None, "", " \n", "a", "A b", "a B c d", "a b c d e", "É é E e a a a a a a a", "x\x0b\x0cy z\tq r\x1cs t", "the " * 50, "a b c d e f g " * 3]
    for batch in (texts, texts[::-1], [None], []):
        sets = S.shingle_sets(pa.array(batch, pa.string()))
        assert [len(s) for s in sets] == [len(grams(t)) for t in batch]
    a, b = S.shingle_sets(pa.array(["x a b C d e", "q a B c d e r"]))
    assert len(np.intersect1d(a, b)) == 1


def test_bounds_never_cut_a_link():
    rng = random.Random(2)
    for _ in range(400):
        x = np.array(sorted(rng.sample(range(60), rng.randint(1, 30))))
        y = np.array(sorted(set(rng.sample(range(60), rng.randint(1, 30))) | set(rng.sample(list(x), rng.randint(1, len(x))))))
        both = np.intersect1d(x, y)
        assert J.overlap_bound(x, y) >= len(both)
        g = rng.choice(list(both))
        link = 100 * len(both) >= 80 * (len(x) + len(y) - len(both))
        least = -(-80 * (len(x) + len(y)) // 180)
        assert J.verified(x, y, int(np.searchsorted(x, g)), int(np.searchsorted(y, g)), least) == link


def corpus(seed):
    """Families of near copies, chains, copies, shared passages and lone documents."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(20)]
    texts = [None, "", " ", "one two", "One  two", "three", "three"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(12, 60))]
        for _ in range(rng.randint(1, 14)):
            other = list(base)
            for _ in range(rng.randint(0, 2)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    chain = [word() for _ in range(70)]
    for i in range(12):
        texts.append(" ".join(chain[i * 2 : i * 2 + 40]))
    for _ in range(15):
        texts.append(" ".join(passage + [word() for _ in range(rng.randint(0, 12))]))
        texts.append(" ".join(word() for _ in range(rng.randint(1, 30))))
    rng.shuffle(texts)
    return [(1000 - 3 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "num", "den", "size", "bucket"), [(1, 80, 100, 5, 10**6), (2, 80, 100, 5, 40), (3, 50, 100, 3, 100), (4, 1, 1, 5, 100)])
def test_components_equal_brute_force(spark, seed, num, den, size, bucket):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class string").repartition(3)
    want, key = brute(rows, num, den, size)
    out = J.near_duplicates(docs, num=num, den=den, size=size, bucket_grams=bucket).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == want


def test_repeated_rows_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", 1)
    base = [f"w{i}" for i in range(40)]
    near = [*base[:20], "new", *base[21:]]
    far = [f"v{i}" for i in range(30)]
    rows = [(5, " ".join(base)), (5, " ".join(base)), (7, " ".join(near)), (7, " ".join(far)), (None, " ".join(near)), (None, "alone here"), (None, None), (9, " ".join(far)), (9, ""), (3, " ".join([*near, "end"]))]
    want, key = brute(rows, 80, 100, 5)
    out = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == want


def test_empty_table_and_thresholds(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(docs).count() == 0
    with pytest.raises(ValueError):
        J.near_duplicates(docs, num=0)


def test_rounds_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(7), "doc_id long, text string")
    monkeypatch.setattr(J, "BLOCK_ROWS", 9)
    whole = J.classes_linked
    seen = []
    for rounds in ((), (1,), (2, 3)):
        monkeypatch.setattr(J, "classes_linked", lambda *a, r=rounds: whole(*a, rounds=r))
        seen.append(sorted((r["id"], r["component_id"]) for r in J.near_duplicates(docs).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    assert {r["node"]: r["component"] for r in J.components(edges).collect()} == {f"{i:03d}": "000" for i in range(61)} | {"x": "x", "y": "x"}


def test_bins_bound_the_overlap_of_whole_sets():
    rng = random.Random(3)
    for _ in range(200):
        x = np.array(sorted(rng.sample(range(1 << 12), rng.randint(1, 90))))
        y = np.array(sorted(set(rng.sample(range(1 << 12), rng.randint(1, 40))) | set(rng.sample(list(x), rng.randint(1, len(x))))))
        assert np.minimum(J.bins_of(x), J.bins_of(y)).sum() >= len(np.intersect1d(x, y))


def test_a_block_is_dealt_whole_and_costs_the_same_at_any_number_of_buckets():
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.integers(0, 1 << 63, rng.integers(0, 400), dtype=np.uint64) * np.uint64(2), common[: rng.integers(0, 50)]))) for _ in range(3000)]
    sent = {}
    for buckets in (1, 20, 60_000):  # at 0.1 GB, and at 600 GB, of texts
        dealt = J.deal(sets, buckets)
        back = [[] for _ in sets]
        for g, t, at in zip(dealt.grams, dealt.times, np.cumsum(dealt.times) - dealt.times):
            for o in dealt.owners[at : at + t]:
                back[o].append(g)
        assert all(np.array_equal(np.sort(np.array(b, np.uint64)), s) for b, s in zip(back, sets))
        parts = list(dealt.parts())
        assert [k for k, _ in parts] == sorted({int(x) for x in J.bucket_of(dealt.grams, buckets)})
        assert sum(p.stop - p.start for _, p in parts) == len(dealt.grams) == len(np.unique(dealt.grams))
        assert all((J.bucket_of(dealt.grams[p], buckets) == k).all() for k, p in parts)
        sent[buckets] = sum(4 * (p.stop - p.start) for _, p in parts) + dealt.owners.nbytes + len(J.narrow(dealt.times))
    assert len(set(sent.values())) == 1


def test_hot_grams_come_once_a_block():
    sets = [np.array([7, 10 + i], np.uint64) for i in range(5000)]
    dealt = J.deal(sets, 4)
    assert (dealt.grams == 7).sum() == 1 and dealt.times[dealt.grams == 7][0] == 5000
    assert J.deal([], 4).grams.size == 0 and J.deal([np.zeros(0, np.uint64)], 4).owners.size == 0


def test_input_in_no_order_is_written_first(spark, tmp_path):
    docs = spark.createDataFrame(corpus(9), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    assert J.steady(files.where("doc_id > 3").select("text"), "x")._jdf.queryExecution().optimizedPlan().toString().count("Filter") == 1
    shuffled = files.repartition(5).groupBy("doc_id").agg({"text": "max"})
    assert "Aggregate" not in J.steady(shuffled, "x")._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_hashed_alike_at_any_piece(monkeypatch):
    texts = [None, "", " \n", "a", "A b", " a B c d ", "É é E e a a a a a a a", "x\x0b\x0cy z\tq r\x1cs t", "the " * 50, "long" * 40, " " * 90 + "b"]
    whole, counts = S.word_hashes(pa.array(texts))
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(S, "PIECE", piece)
        again, same = S.word_hashes(pa.array(texts))
        assert np.array_equal(whole, again) and np.array_equal(counts, same)


def taken(f):
    """Bytes that a call takes at most at once, beside what it was given."""
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    del out
    return most


def test_a_worker_takes_little_beside_its_block():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(1000)]
    grams = sum(map(len, sets))
    times = [np.ones(len(s), np.int64) for s in sets]
    assert taken(lambda: J.deal(sets, 17)) < 50 * grams
    assert taken(lambda: J.totals(sets, times)) < 50 * grams
    texts = pa.array([" ".join(f"w{i}" for i in range(300_000))])
    assert taken(lambda: S.word_hashes(texts)) < 20 * texts.nbytes


def test_a_block_is_sent_in_parts_whole_and_in_order():
    rows = [J.blank(k, "x", J.COUNTS, a=bytes([k]) * (J.SENT_BYTES // 3)) for k in range(10)] + [J.blank(3, "x", J.ROWS, a=b"o" * 3 * J.SENT_BYTES, ids=[4, None])]
    batches = list(J.sent(list(rows)))
    assert [r for b in batches for r in b.to_pylist()] == rows
    assert [b.num_rows for b in batches] == [3, 3, 3, 1, 1]
    assert list(J.sent([])) == []
