"""Quality classifier: hashed word n-grams, logistic regression by FTRL-proximal.

Words are maximal runs of letter bytes (ASCII letters and digits, all bytes from 0x80) or
of other bytes that are not white space. Uni- and bigrams are hashed to 2**bits places; a
word that repeats the one before it counts as a gram of its own. A text's vector holds
count / sqrt(number of grams), its score is the logistic of a sparse dot product.

Training sees a bounded sample of labelled rows (`train_rows`), whole texts, in a fixed
order, and needs both labels; a single label gives that label's constant score, none 0.5.
Null texts count as empty and score by the bias alone. Rows are scored by themselves, so
repeated rows get equal scores; a document that occurs several times among the training
rows is learned from once, with the mean of its labels rounded. All columns are kept; an
output replaces an input column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.common import first_share, fresh, give_back, slices, small_batches

#: Fixed odd multipliers of the hashes.
STEP, MIX, PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

SPACE, MARK, LETTER = 0, 1, 2


def byte_classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        out[a:b] = LETTER
    return out


CLASSES = byte_classes()


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def grams(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all grams of the texts, one text after the other, and how many each has."""
    n = len(texts)
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    kind = CLASSES[raw]
    first = np.ones(len(raw), bool)
    first[1:] = kind[1:] != kind[:-1]
    at = ends[:-1]
    first[at[at < len(raw)]] = True
    first &= kind != SPACE
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    used = np.flatnonzero(kind != SPACE)
    word = np.cumsum(first[used]) - 1
    place = used - starts[word]
    sums = np.add.reduceat((raw[used].astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place], np.searchsorted(used, starts))
    hashes = mixed(sums)
    owner = np.searchsorted(ends, starts, side="right") - 1
    near = owner[1:] == owner[:-1]
    pairs = mixed(hashes[:-1] * PAIR + hashes[1:])
    pairs[hashes[:-1] == hashes[1:]] = 1  # the word once more
    shift = np.uint64(64 - bits)
    places = np.concatenate((hashes, pairs[near] * MIX)) >> shift
    owners = np.concatenate((owner, owner[1:][near]))
    turn = np.argsort(owners, kind="stable")
    return places[turn].astype(np.int64), np.bincount(owners, minlength=n)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    return (h ^ (h >> np.uint64(29))) * STEP


@dataclass
class Model:
    weights: np.ndarray  # float32, 2**bits
    bias: float
    bits: int

    def score(self, texts: pa.Array) -> np.ndarray:
        places, counts = grams(texts, self.bits)
        z = np.full(len(counts), self.bias)
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            z[some] += np.add.reduceat(self.weights[places].astype(np.float64), starts) / np.sqrt(counts[some])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(rows: Sequence[tuple[str | None, int]], bits: int = 20, epochs: int = 6, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """FTRL-proximal over the rows in the given order; every coordinate has its own rate."""
    labels = {y for _, y in rows}
    if len(labels) < 2:
        return Model(np.zeros(1 << bits, np.float32), {frozenset(): 0.0, frozenset({1}): 30.0, frozenset({0}): -30.0}[frozenset(labels)], bits)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    vectors = []
    for text, _ in rows:
        places, counts = grams(pa.array([text], pa.string()), bits)
        where, times = np.unique(places, return_counts=True)
        vectors.append((np.append(where, 1 << bits).astype(np.int32), np.append(times / np.sqrt(max(1, counts[0])), 1.0).astype(np.float32)))

    def weights(i) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for (i, x), (_, y) in zip(vectors, rows, strict=True):
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -500, 500)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(slice(None))
    model = Model(w[:-1].astype(np.float32), float(w[-1]), bits)
    del vectors, z, n, w
    give_back()  # the driver's memory is small, and training is done
    return model


def sample(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", train_rows: int = 6000) -> list[tuple[str | None, int]]:
    """About `train_rows` labelled rows at most, chosen and ordered by a hash of their id."""
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.round(F.avg(label_col)).cast("int").alias("_y"))
    total = known.count()
    if not total:
        return []
    order = F.xxhash64(F.col("doc_id"), F.lit(29))
    chosen = known.where(order <= F.lit(first_share(train_rows, total))).withColumn("_o", order)
    # Bounded by train_rows, so it is sent to the documents and not they to it.
    found = docs.select(F.col("doc_id"), F.col("text").alias("_text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_y", "_o").agg(F.min("_text").alias("_text"))
    # In the order of the hash, a part of the sample at a time on the driver.
    return [(r["_text"], r["_y"]) for r in found.orderBy("_o", "doc_id").select("_text", "_y").toLocalIterator()]


def classify(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None, threshold: float = 0.3, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs (or the columns `keep` of it) with the score and 1 where it reaches the threshold."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (score_col.lower(), predicted_col.lower())]
    body = fresh("body", keep)
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(body))
    shared = spark.sparkContext.broadcast(model)  # 2**bits floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, body, chars=1 << 20):
            p = shared.value.score(b.column(body))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, score_col, predicted_col])

    return source.mapInArrow(run, T.StructType([*(source.schema[c] for c in keep), T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())]))
