import base64
import random
import re
import string
from collections import Counter

import zstandard

from nearfold.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if seen[w] >= 2:
            covered |= {i, i + 1, i + 2}
    lines, earlier, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def texts():
    rng = random.Random(5)
    words = ["the", "été", "a", "#x", "**", "中文", " ", "b|c", " ", "x\x1cy"]
    out = [None, "", " ", "\n\n", "a a a a", "a b c a b c", "\x0b\x0c\ra\tb", " a ", "a\n a\na\n"]
    out += ["".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", "\n\n", "\r\n"]) for _ in range(n)) for n in (3, 10, 60, 300, 2000)]
    return out


def test_base_counts(spark):
    rows = list(enumerate(texts()))
    out = {r["doc_id"]: r.asDict() for r in rules.compression_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = brute(text)
        assert {k: out[i][k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert out[i]["base_failed"] == failed and not (failed and out[i]["kept"])


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(900)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(4000))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)) for _ in range(200))
    loop = " ".join(vocabulary[:70]) + " "
    rows = [(1, prose), (2, noise), (3, loop * 60), (4, prose + loop * 300), (5, "short text " * 3)]
    out = {r["doc_id"]: r for r in rules.compression_rules(spark.createDataFrame(rows, "doc_id long, text string"), bands=((64, 0.1, 0.7),)).collect()}
    assert out[1]["kept"] and not out[3]["kept"] and not out[4]["kept"] and not out[2]["kept"]
    assert out[2]["ratio"] > 0.7
    assert out[4]["n_bad_chunks"] > 0.25 * out[4]["n_chunks"]
    assert not out[5]["kept"] and out[5]["base_failed"]


def test_limits_by_length():
    assert rules.limits(10, rules.BANDS) is None
    assert rules.limits(2000, rules.BANDS) == rules.BANDS[1][1:]


def test_large_vocabulary_and_clashing_columns(spark):
    assert rules.repeated_words(__import__("numpy").array([5, 6, 7, 1, 5, 6, 7]), 1 << 21) == 6
    docs = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, KEPT int, body string")
    row = rules.compression_rules(docs).collect()[0]
    assert row["kept"] is False and row["body"] == "x"
    assert rules.compression_rules(docs.limit(0)).count() == 0


def junk(kind, size, rng):
    if kind == "letters":
        return " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(size))[:size]
    if kind == "cjk":
        return " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(5)) for _ in range(size // 16 + 1))[: size * 6 // 16 + 1]
    raw = base64.b64encode(rng.randbytes(size)).decode() if kind == "base64" else rng.randbytes(size).hex()
    return " ".join(raw[i : i + 8] for i in range(0, size, 8))[:size]


def judged(spark, rows):
    out = rules.compression_rules(spark.createDataFrame(list(rows.items()), "doc_id string, text string")).collect()
    return {r["doc_id"]: r for r in out}


def test_default_bands_reject_noise_and_keep_prose(spark):
    rng = random.Random(4)
    least = {"base64": 1024, "cjk": 1024, "letters": 3000, "hex": 5000}
    rows = {f"{kind} {n}": junk(kind, n, rng) for kind in least for n in (1024, 3000, 5000, 20_000, 60_000) if n >= least[kind]}
    out = judged(spark, rows)
    assert not any(r["base_failed"] for r in out.values()) and not [i for i, r in out.items() if r["kept"]]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    known = rules.compression_rules(docs).collect()
    high = [r for r in known if not r["base_failed"] and r["ratio"] > 0.3]
    assert len(high) > 100 and sum(r["kept"] for r in high) / len(high) > 0.95


def test_passages_of_ordinary_documents_are_judged(spark):
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) between 16000 and 60000").select("text").limit(200).collect()
    prose = min((r["text"] for r in docs), key=lambda x: (brute(x)["n_repeat_words"] / len(x.split()), x))
    line = "This is the one line of the page that is said again and again and again.\n"
    rows = {"prose": prose[:14_000], "short": prose[:3000]}
    rows |= {"loop at the end": prose[:16_000] + line * 160, "loop inside": prose[:3000] + line * 56 + prose[3000:6000]}
    rows |= {"blob inside": prose[:3000] + junk("base64", 4200, rng) + prose[3000:6000], "blob at the end": prose[:9000] + junk("base64", 1800, rng)}
    out = judged(spark, rows)
    assert [i for i, r in out.items() if r["kept"]] == ["prose", "short"]
    assert not any(out[i]["base_failed"] for i in rows)
    assert out["short"]["n_chunks"] == 2 and out["short"]["n_bad_chunks"] == 0


def by_hand(text):
    """ratio, chunks, bad chunks and the verdict of the bands, step by step."""
    raw = (text or "").encode()
    squeezed = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x)) / len(x)

    def fits(x, band):
        wide = sum(b in range(0xE3, 0xEE) or b in range(0xF0, 0xF5) for b in x)
        most = band[1] + min(1.0, 3 * wide / len(x)) * (band[2] - band[1])
        return band[0] <= squeezed(x) <= most

    bands = [b[1:] for b in rules.BANDS if len(raw) >= b[0]]
    chunks, at = [], 0
    while len(raw) >= 2048 and at < len(raw):
        start = min(at, len(raw) - 2048)
        chunks.append(raw[start : start + 2048])
        at += 2048
    bad = sum(not fits(x, rules.CHUNK_BAND) for x in chunks)
    kept = (not bands or fits(raw, bands[-1])) and 10 * bad <= len(chunks)
    return squeezed(raw) if raw else None, len(chunks), bad, kept


def test_bands_equal_brute_force(spark):
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    rows = texts() + [r["text"] for r in docs] + [junk(kind, n, rng) for kind in ("base64", "cjk", "letters", "hex") for n in (300, 2047, 2048, 2049, 9000)]
    rows += [rows[-1] + "the same line again and again\n" * n for n in (3, 80, 700)]
    seen = set()
    for i, r in judged(spark, {str(i): t for i, t in enumerate(rows)}).items():
        ratio, chunks, bad, kept = by_hand(rows[int(i)])
        assert (r["ratio"], r["n_chunks"], r["n_bad_chunks"]) == (ratio, chunks, bad) and r["kept"] == (kept and not r["base_failed"])
        seen.add((r["base_failed"], kept))
    assert {(False, True), (False, False)} <= seen
