import base64
import hashlib
import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from nearfold.llm import jaccard, quality
from nearfold.llm.common import crc_remainder, table
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import by_hand
from tests.llm.test_pii import base

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = table(spark, SF, "documents")
    out = {"documents": [tuple(r) for r in docs.collect()]}
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
        out[name] = [tuple(r) for r in docs.collect()]
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_quality_keeps_what_the_model_keeps(spark, stages):
    docs = table(spark, SF, "documents")
    model = quality.train(quality.sample(docs, table(spark, SF, "labels"), crc_remainder("doc_id", 5) != 0))
    kept = {r["doc_id"] for r in quality.classify(docs, model).collect() if r["score"] >= 0.3}
    assert sorted(stages["quality_classifier"]) == sorted(r for r in stages["documents"] if r[0] in kept)
    bad = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 0").collect()}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert len(bad & kept) <= 0.2 * len(bad) and len(good - kept) <= 0.02 * len(good)


def test_one_document_of_each_group_stays(stages):
    rows = [(r[0], r[1]) for r in stages["quality_classifier"]]
    found, _ = brute(rows, 80, 100, 5)
    want = {i for i, n, least in found if n == 0 or i == least}
    assert sorted(stages["ngram_jaccard_join"]) == sorted(r for r in stages["quality_classifier"] if r[0] in want)


def test_personal_data_is_gone_and_nothing_else(stages):
    before = {r[0]: r for r in stages["ngram_jaccard_join"]}
    assert sorted(before) == sorted(r[0] for r in stages["pii"])
    for i, text, *rest in stages["pii"]:
        spans, was = base(before[i][1]), before[i][1]
        if not spans:
            assert text == was
        want, at = "", 0
        runs = []
        for s, _, kind, e in spans:
            if runs and s < runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], e)
            else:
                runs.append([s, kind, e])
        for s, kind, e in runs:
            want += was[at:s] + f"[{kind.upper()}]"
            at = e
        assert text == want + was[at:] and rest[-1] == len(text) and tuple(rest[:2]) == before[i][2:4]


def test_mix_meets_its_targets(stages):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in stages["pii"]}
    names = sorted({r[3] for r in stages["pii"]})
    totals = [sum(size[r[0]] for r in stages["pii"] if r[3] == x) for x in names]
    copies = Counter(r[0] for r in stages["mixing"])
    assert max(copies.values()) <= 3 and set(stages["mixing"]) <= set(stages["pii"])
    for x, target in zip(names, by_hand(totals, [(1, 2, 3)[i % 3] for i in range(len(names))], 3.0)):
        mine = [r[0] for r in stages["pii"] if r[3] == x]
        assert abs(sum(size[i] * copies[i] for i in mine) - target) <= max(size[i] for i in mine)


def test_tokens_of_every_row(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text, *_ in stages["mixing"]:
        ids = enc.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(stages["byte_bpe"]) == sorted(want)


def test_run_returns_the_last_stage(spark, stages):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(stages["byte_bpe"])


def test_one_of_each_with_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (4, "other words here and there"), (None, text), (None, "all alone"), (None, "all alone"), (2, text + " end"), (9, ""), (9, None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, _class string, _N int, _gone int")
    out = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()), key=str)
    assert out == sorted([(2, text + " end"), (4, "other words here and there"), (None, "all alone"), (9, ""), (9, None)], key=str)
    assert jaccard.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_any_name_pass_through(spark):
    words = " ".join(f"w{i}" for i in range(30))
    names = ["size", "pattern", "target", "taken", "source_size", "score", "predicted", "base", "spans", "redacted", "_score", "_spans", "document", "col", "_copy", "gone"]
    rows = [(1, words + " a@b.co", "en", "s", 5, *range(99, 99 + len(names))), (2, None, None, None, None, *range(len(names))), (3, "", "de", "s", 0, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert tuple(r)[5:] == tuple(rows[r["doc_id"] - 1][5:]), name
        assert stage(spark, docs.limit(0), SF).count() == 0
