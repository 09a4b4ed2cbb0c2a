"""Language ID by a bidirectional gated recurrent network over bytes.

Texts are lower-cased and read as one sequence of UTF-8 bytes, spaces, digits, marks and
punctuation included, in overlapping windows of WINDOW bytes. Gates and states are squashed
by x / (1 + |x|), which costs a fraction of a hyperbolic tangent. One recurrent layer reads a
window forwards, one backwards, and every byte of the text gets a distribution over the
languages, once: the MARGIN bytes where a window meets the next are context only. A
document's distribution is the mean over all its bytes. The network is trained here, in
numpy, by backpropagation through time on a bounded sample of labelled documents.

Null texts and texts without a letter are `und` with score 0, and so is every text where
no language was learned. Equal means go to the lesser name. Rows are judged by themselves,
so repeated rows get equal results. All columns are kept; an output replaces an input
column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.common import first_share, fresh, give_back, slices, small_batches

LETTER = regex.compile(r"\p{L}")
WINDOW = 256
#: Bytes of the windows that training draws.
LEARNT = 128
MARGIN = 16
STRIDE = WINDOW - 2 * MARGIN
UNKNOWN = "und"

#: Windows that a worker reads at once.
MEMO = 1024
#: Batches are filled up to a multiple of this, so that a window's sums are the same
#: whatever it is read with.
ROWS = 16


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def slope(y: np.ndarray) -> np.ndarray:
    """Of squash, where it is y."""
    return (1 - np.abs(y)) ** 2


def read(x: np.ndarray, table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """States (rows, time, hidden) of one direction over bytes x (rows, time)."""
    hidden = u.shape[0]
    h = np.zeros((len(x), hidden), table.dtype)
    out, kept = np.empty((*x.shape, hidden), table.dtype), []
    for t in range(x.shape[1]):
        g, a = table[x[:, t]], h @ u
        zr = 0.5 + 0.5 * squash(g[:, : 2 * hidden] + a[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        n = squash(g[:, 2 * hidden :] + r * a[:, 2 * hidden :])
        kept.append((h, z, r, n, a[:, 2 * hidden :]))
        h = n + z * (h - n)
        out[:, t] = h
    return out, kept


def unread(x: np.ndarray, d_out: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of u, backwards through time."""
    hidden = u.shape[0]
    d_u, d_g, dh = np.zeros_like(u), np.empty((*x.shape, 3 * hidden), u.dtype), np.zeros((len(x), hidden), u.dtype)
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, n, an = kept[t]
        dh = dh + d_out[:, t]
        dn = dh * (1 - z) * slope(n)
        dz = dh * (h - n) * 0.5 * slope(2 * z - 1)
        dr = dn * an * 0.5 * slope(2 * r - 1)
        da = np.concatenate((dz, dr, dn * r), axis=1)
        d_g[:, t] = np.concatenate((dz, dr, dn), axis=1)
        d_u += h.T @ da
        dh = dh * z + da @ u.T
    seen = np.zeros((x.size, 256), u.dtype)
    seen[np.arange(x.size), x.reshape(-1)] = 1
    return seen.T @ d_g.reshape(x.size, -1), d_u


def apart(m: np.ndarray) -> np.ndarray:
    """The columns of the gates z, r and n, one after the other."""
    return np.ascontiguousarray(np.stack(np.split(m, 3, axis=1)))


def scan(x: np.ndarray, table: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
    """As `read`, over bytes x (time, rows), into `out` (time, rows, hidden), without what
    training needs."""
    table, u = apart(table), apart(u)
    rows, hidden = x.shape[1], u.shape[1]
    h, a, g = (np.zeros((*n, rows, hidden), u.dtype) for n in ((), (3,), (3,)))
    size = np.empty((2, rows, hidden), u.dtype)
    zr, z, r, n, below = a[:2], a[0], a[1], a[2], size[0]
    for t, row in enumerate(x):
        np.matmul(h, u, out=a)
        np.take(table, row, axis=1, out=g, mode="clip")
        zr += g[:2]
        np.abs(zr, out=size)
        size += 1
        zr /= size
        zr *= 0.5
        zr += 0.5
        n *= r
        n += g[2]
        np.abs(n, out=below)
        below += 1
        n /= below
        h -= n
        h *= z
        h += n
        out[t] = h


@dataclass
class Network:
    languages: list[str]
    params: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], hidden: int, rng: np.random.Generator, dtype=np.float32) -> Network:
        p = {}
        for side in ("f", "b"):
            p[f"{side}_table"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(dtype)
            p[f"{side}_u"] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(dtype)
        p["w"] = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(dtype)
        p["c"] = np.zeros(len(languages), dtype)
        return cls(languages, p)

    def forward(self, x: np.ndarray, back: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Distributions (rows, time, languages). back: each row's bytes from its end;
        turn: for each position where its byte stands in `back`."""
        p = self.params
        hf, kf = read(x, p["f_table"], p["f_u"])
        hb, kb = read(back, p["b_table"], p["b_u"])
        h = np.concatenate((hf, np.take_along_axis(hb, turn[:, :, None], axis=1)), axis=2)
        s = h @ p["w"] + p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True), (h, kf, kb)

    def gradients(self, x, back, turn, labels: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all real positions, and its gradients."""
        p, hidden = self.params, self.params["f_u"].shape[0]
        probs, (h, kf, kb) = self.forward(x, back, turn)
        real = np.arange(x.shape[1])[None, :] < lengths[:, None]
        total = real.sum()
        rows, times = np.nonzero(real)
        loss = -np.log(probs[rows, times, labels[rows]] + 1e-12).sum() / total
        ds = probs.copy()
        ds[np.arange(len(x)), :, labels] -= 1
        ds = (ds * real[:, :, None] / total).astype(p["w"].dtype)
        dh = ds @ p["w"].T
        db = np.zeros_like(dh[:, :, hidden:])
        np.put_along_axis(db, turn[:, :, None], dh[:, :, hidden:] * real[:, :, None], axis=1)
        g = {"w": h.reshape(-1, 2 * hidden).T @ ds.reshape(-1, ds.shape[2]), "c": ds.sum(axis=(0, 1))}
        g["f_table"], g["f_u"] = unread(x, dh[:, :, :hidden], p["f_u"], kf)
        g["b_table"], g["b_u"] = unread(back, db, p["b_u"], kb)
        return float(loss), g

    def window_sums(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each window of `raw`, the sum of the distributions at positions first to
        last (exclusive)."""
        p, n = self.params, int(sizes.max())
        half = p["f_u"].shape[0]
        time, ends = np.arange(n)[:, None], starts + sizes - 1
        forwards, backwards = raw[np.minimum(starts + time, ends)], raw[np.maximum(ends - time, starts)]
        ahead, back = (np.empty((n, len(starts), half), p["w"].dtype) for _ in "fb")
        scan(forwards, p["f_table"], p["f_u"], ahead)
        if (sizes == n).all():
            scan(backwards, p["b_table"], p["b_u"], back[::-1])
        else:
            scan(backwards, p["b_table"], p["b_u"], back)
            back = np.take_along_axis(back, np.maximum(sizes - 1 - time, 0)[:, :, None], axis=0)
        s = ahead.reshape(-1, half) @ p["w"][:half]
        s += back.reshape(-1, half) @ p["w"][half:]
        s = np.ascontiguousarray(s.T) + p["c"][:, None]  # (languages, time and rows)
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s *= ((time >= first) & (time < last)).reshape(-1) / s.sum(axis=0)
        return s.reshape(len(s), n, -1).sum(axis=1, dtype=np.float64).T

    def text_means(self, texts: Sequence[bytes]) -> np.ndarray:
        """For each text (none is empty) the mean of the distributions of all its bytes."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        lengths = np.array([len(t) for t in texts])
        counts, sizes = 1 + -(-np.maximum(lengths - WINDOW, 0) // STRIDE), np.minimum(lengths, WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.minimum(k * STRIDE, (lengths - sizes)[owner])
        before = np.where(k > 0, (k - 1) * STRIDE + WINDOW - MARGIN, 0)  # the windows before label up to here
        upto = np.where(k == counts[owner] - 1, lengths[owner], at + WINDOW - MARGIN)
        starts = at + (np.cumsum(lengths) - lengths)[owner]
        out = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(sizes[owner], kind="stable")
        for i in range(0, len(order), MEMO):
            j = order[i : i + MEMO]
            some = owner[j]
            j = np.append(j, np.repeat(j[-1:], -len(j) % ROWS))
            np.add.at(out, some, self.window_sums(raw, starts[j], sizes[owner[j]], (before - at)[j], (upto - at)[j])[: len(some)])
        return out / lengths[:, None]


def padded(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    n = int(lengths.max())
    x = np.zeros((len(words), n), np.intp)
    back = np.zeros_like(x)
    for i, w in enumerate(words):
        x[i, : len(w)] = list(w)
        back[i, : len(w)] = list(w[::-1])
    turn = np.where(np.arange(n)[None, :] < lengths[:, None], lengths[:, None] - 1 - np.arange(n)[None, :], np.arange(n)[None, :])
    return x, back, turn, lengths


def runs(text: str) -> list[str]:
    """What is read of a text: all of it, or nothing if it has no letter."""
    return [text.lower()] if LETTER.search(text) else []


def train(rows: Sequence[tuple[str, str]], hidden: int = 12, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
    """A network from (language, text) rows, languages drawn evenly. Adam, fixed seed."""
    words: dict[str, list[bytes]] = {}
    for lang, text in rows:
        for w in runs(text):
            raw = w.encode()
            words.setdefault(lang, []).extend(raw[a : a + LEARNT] for a in range(0, max(1, len(raw) - 2 * MARGIN), LEARNT - 2 * MARGIN))
    languages = sorted(words)
    if not languages:
        return Network([])
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, hidden, rng)
    if len(languages) == 1:
        return net
    m = {k: np.zeros_like(v) for k, v in net.params.items()}
    s = {k: np.zeros_like(v) for k, v in net.params.items()}
    for step in range(1, steps + 1):
        labels = rng.integers(0, len(languages), batch)
        drawn = [words[languages[y]][rng.integers(0, len(words[languages[y]]))] for y in labels]
        _, g = net.gradients(*padded(drawn)[:3], labels, np.array([len(w) for w in drawn]))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in net.params.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            v -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(v.dtype)
    del words
    give_back()
    return net


class Reader:
    """A network that labels texts, MEMO windows at once."""

    def __init__(self, net: Network) -> None:
        self.net = net

    def judge(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        found = [w.encode() if self.net.languages else b"" for t in texts for w in (runs(t or "") or [""])]
        langs, scores = [UNKNOWN] * len(found), np.zeros(len(found))
        at = [i for i, w in enumerate(found) if w]
        if at:
            means = self.net.text_means([found[i] for i in at])
            for i, mean in zip(at, means, strict=True):
                best = int(mean.argmax())
                langs[i], scores[i] = self.net.languages[best], min(1.0, mean[best])
        return langs, scores


def sample(docs: DataFrame, learn: Column, lang_col: str = "lang", text_col: str = "text", each: int = 300, total: int = 6000) -> list[tuple[str, str]]:
    """About `each` documents of every language, and `total` in all, chosen and ordered by
    a hash of the text; copies are counted and taken once. Every language with a text keeps
    the first of its texts in this order at least."""
    rows = docs.where(learn).select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).where("_lang is not null and _text is not null")
    order = F.xxhash64(F.col("_text"), F.lit(31))
    distinct = rows.select("_lang", order.alias("_o")).distinct()
    found = distinct.groupBy("_lang").agg(F.count("*").alias("n"), F.min("_o").alias("least")).collect()  # a row for each language
    counts = {r["_lang"]: r["n"] for r in found}
    if not counts:
        return []
    each = max(1, min(each, total // len(counts)))
    least = F.create_map(*(x for r in found for x in (F.lit(r["_lang"]), F.lit(r["least"]).cast("long"))))
    upto = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(first_share(each, n)).cast("long"))))
    chosen = rows.where((order <= upto[F.col("_lang")]) | (order == least[F.col("_lang")])).groupBy("_lang", "_text").agg(F.first(order).alias("_o"))
    return [(r["_lang"], r["_text"]) for r in sorted(chosen.collect(), key=lambda r: (r["_o"], r["_lang"], r["_text"]))]


def identify(docs: DataFrame, net: Network, text_col: str = "text", keep: Sequence[str] | None = None, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs (or the columns `keep` of it) with the language and its mean probability."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (lang_col.lower(), score_col.lower())]
    body = fresh("body", keep)
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(body))
    shared = spark.sparkContext.broadcast(net)  # its size follows hidden and languages only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in slices(batches, body, chars=1 << 20):
            langs, scores = reader.judge(b.column(body).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, lang_col, score_col])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in keep), T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())]))
