import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from nearfold.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    parts = ["the", " quick", "'s", "'", "'re", "  ", "\n\n", "\t", " 12", "345", "été", " naïve", "中文", "!!", " ...", "<|endoftext|>", "🙂", " ", " I'll", "''re"]
    out = [None, "", " ", "a", "x" * 3000, " " * 2500 + "y", "'" * 1500 + "re" * 900]
    out += ["".join(rng.choice(parts) for _ in range(n)) for n in (1, 5, 40, 200, 900, 900, 3000)]
    return out


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 512), (64, 8), (17, 3), (256, 200)])
def test_ids_are_the_librarys_for_any_chunks(spark, reference, chunk, overlap):
    rows = [(i, t) for i, t in enumerate(texts())] + [(99, texts()[-1])] * 2 + [(None, "x" * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["token_ids"]) for r in bpe.encode(docs, RANKS, P.PATTERN, chunk_chars=chunk, overlap=overlap).collect())
    want = sorted((i is None, i or 0, t or "", reference.encode_ordinary(t or "")) for i, t in rows)
    assert got == want


def test_round_trip_and_digests(spark, reference):
    rows = list(enumerate(texts()))
    out = {r["doc_id"]: r for r in bpe.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, P.PATTERN).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def exchanges(plan):
    """Names of the columns that each exchange of a physical plan moves."""
    children = plan.children()
    found = [x for i in range(children.size()) for x in exchanges(children.apply(i))]
    if plan.getClass().getSimpleName() == "ShuffleExchangeExec":
        output = plan.output()
        found.append([output.apply(i).name() for i in range(output.size())])
    return found


def test_long_texts_meet_their_rows_as_digests(spark, reference):
    long = [" ".join(f"w{i * k % 977}" for i in range(9000)) for k in (3, 5)]
    rows = [(1, long[0]), (2, long[1]), (3, long[0]), (None, long[0]), (4, "short"), (5, None)]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = bpe.token_digests(spark.createDataFrame(rows, "doc_id long, text string"), RANKS, P.PATTERN)
        moved = exchanges(out._jdf.queryExecution().executedPlan())
        got = sorted(map(tuple, out.collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Ids of a text are gathered once; neither they nor bytes go to the rows.
    assert sum("ids" in x or "token_ids" in x or "buf" in x for x in moved) == 1, moved
    assert not any("decoded" in x for x in moved), moved
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        digests = (hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (t or "").encode()))
        want.append((i, len(ids), *digests))
    assert got == sorted(want, key=str)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, "k")], "doc_id long, text string, Body string, token_ids int, _KEY string")
    for chunk in (100, 2):
        row = bpe.encode(docs, RANKS, P.PATTERN, chunk_chars=chunk, overlap=1).collect()[0]
        assert row["Body"] == "x" and row["_KEY"] == "k" and len(row["token_ids"]) == 2
    assert bpe.token_digests(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), RANKS, P.PATTERN, chunk_chars=8, overlap=8)
