import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearfold.llm import quality as Q
from nearfold.llm.common import crc_remainder


def slow_grams(text, bits):
    """The grams of one text by plain loops."""
    mask = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ (h >> 33)) * int(Q.MIX)) & mask
        return ((h ^ (h >> 29)) * int(Q.STEP)) & mask

    words, last = [], 0
    for b in (text or "").encode():
        kind = Q.CLASSES[b]
        if kind and kind == last:
            words[-1].append(b)
        elif kind:
            words.append([b])
        last = kind
    hashes = [mixed(sum((b + 1) * pow(int(Q.STEP), i, 1 << 64) for i, b in enumerate(w)) & mask) for w in words]
    out = list(hashes)
    for a, b in zip(hashes, hashes[1:]):
        pair = 1 if a == b else mixed((a * int(Q.PAIR) + b) & mask)
        out.append((pair * int(Q.MIX)) & mask)
    return sorted(h >> (64 - bits) for h in out)


def test_grams_equal_plain_loops():
    texts = ["", None, "a", " \n", "the the cat,, sat!!", "été中 x1", "x", "", "a b a b a b", "\x0b\x1cz", "w" * 300]
    for batch in (texts, texts[::-1], texts[2:3], [None], []):
        places, counts = Q.grams(pa.array(batch, pa.string()), 18)
        at = 0
        for text, n in zip(batch, counts):
            assert sorted(places[at : at + n].tolist()) == slow_grams(text, 18)
            at += n
        assert at == len(places)


def corpus(n=600):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows = []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            body = [w + rng.choice(["***", "$$$", "!!"]) for w in body] if rng.random() < 0.5 else [w for w in body for _ in range(3)]
        rows.append((i, " ".join(body), int(not bad)))
    return rows


def test_learns_and_scores_rows_by_themselves(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t, _ in rows] + [(None, None, None, 5), (7, "", "k", 5)], "doc_id long, text string, body string, SCORE int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = Q.sample(docs, labels, crc_remainder("doc_id", 5) != 0)
    known = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5}
    assert len(got) == len(known) and Q.sample(docs, labels, F.lit(True), train_rows=50)
    model = Q.train(got)
    out = Q.classify(docs, model).collect()
    score = {(r["doc_id"], r["text"]): r for r in out}
    held = [(r, q) for i, t, q in rows if i not in known for r in [score[i, t]]]
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert score[None, None]["score"] == score[7, ""]["score"]
    again = Q.classify(docs.repartition(5), Q.train(Q.sample(docs.repartition(3), labels.repartition(2), crc_remainder("doc_id", 5) != 0))).collect()
    assert {(r["doc_id"], r["text"]): r["score"] for r in again} == {k: r["score"] for k, r in score.items()}


def test_one_label_no_label_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert Q.classify(docs, Q.train([])).collect()[0]["score"] == 0.5
    assert Q.classify(docs, Q.train([("x", 1)])).collect()[0]["score"] > 0.99
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.sample(docs, labels, F.lit(True)) == []
    assert Q.classify(docs.limit(0), Q.train([])).count() == 0
