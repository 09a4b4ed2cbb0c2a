"""Byte-level BPE by overlapping chunks.

Texts longer than `chunk_chars` are cut into chunks that overlap by `overlap` characters,
the chunks are dealt over the cluster and pre-tokenised apart. A match of the pattern
depends only on what follows its start, so from the first boundary that two neighbours
both found in their overlap they agree for good: there the chunks are stitched. The
pieces between two stitches are encoded where they lie, and the ids of a text are put
together in order. Neighbours that share no boundary (one token longer than the overlap)
are encoded as one piece, up to the next stitch; if the matches of that piece do not come
to the boundary of this stitch, so that it was none, the text is encoded whole. No setting
changes the ids.

Null and empty texts get no ids. Repeated rows are encoded once if long. All columns are
kept; an output column replaces an input column of the same name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfold.llm.common import fresh, give_back, slices, small_batches, stored

#: A match is settled once this many characters after its start are known (the longest
#: contraction of the pattern has three).
LOOK = 3

#: Pieces that a worker remembers.
MEMO = 100_000


class Encoder(dict):
    """piece -> ids, remembered up to MEMO pieces."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})._core_bpe
        self.known = table
        self.bytes_of = {v: k for k, v in table.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        ids = (self.known[raw],) if raw in self.known else tuple(self.core.encode_single_piece(raw))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str, starts: int = 0, ends: int | None = None) -> np.ndarray:
        """Ids of the matches from the boundary `starts` to the boundary `ends`. The text
        behind `ends` must be there: what follows white space decides how it is split."""
        return self.ids_upto(text, starts, ends)[0]

    def ids_upto(self, text: str, starts: int, ends: int | None) -> tuple[np.ndarray, bool]:
        """The ids, and whether a match ends at `ends`."""
        out: list[int] = []
        at, ends = starts, len(text) if ends is None else ends
        for piece in self.pattern.findall(text, starts):
            if at >= ends:
                break
            at += len(piece)
            out += self[piece]
        return np.array(out, dtype=np.int32), at == ends


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = (hash(ranks), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def read_ranks(path: str) -> bytes:
    """The rank file, read on the driver; it is sent to the executors as a broadcast,
    whose size is that of a vocabulary and does not grow with the data."""
    with open(path, "rb") as f:
        return f.read()


def boundaries(pattern, text: str, last: bool) -> list[int]:
    """Starts of the matches in a chunk that no later text can change, and the end of
    the last such match. `last`: the chunk ends where the text ends."""
    out, end = [0], len(text)
    for m in pattern.finditer(text):
        if not last and max(m.end() + 2, m.start() + LOOK) > end:
            break
        out.append(m.end())
    return out


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", keep: list[str] | None = None, chunk_chars: int = 32_768, overlap: int = 512, decoded_col: str | None = None) -> DataFrame:
    """docs (or the columns `keep` of it) with the ids of every text, array<int>, and, if
    decoded_col is given, the bytes that the ids decode to."""
    short, long, distinct, name = encoded_apart(docs, ranks_path, pattern, text_col, out_col, keep, chunk_chars, overlap, decoded_col)
    return short.unionByName(long.join(distinct, name).drop(name))


def encoded_apart(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", keep: list[str] | None = None, chunk_chars: int = 32_768, overlap: int = 512, decoded_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """What encode() puts together: the rows with short texts, encoded; the rows with long
    ones, with a key of the text; the key and what is encoded of each long text, once; the
    key's name."""
    if not 0 < overlap < chunk_chars:
        raise ValueError("overlap must lie between 0 and chunk_chars")
    spark = docs.sparkSession
    small_batches(spark)
    added = [out_col, decoded_col] if decoded_col else [out_col]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in [x.lower() for x in added]]
    text = fresh("body", keep)
    frame = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(text))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    ids_type = T.ArrayType(T.IntegerType(), False)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for b in slices(batches, text):
            ids = [enc.ids(x) if x else np.zeros(0, np.int32) for x in b.column(text).to_pylist()]
            raw = [pa.array([joined_bytes(enc.bytes_of, x.tolist()) for x in ids], pa.binary())] if decoded_col else []
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), lists(ids), *raw], names=[*keep, *added])

    schema = T.StructType([*(frame.schema[c] for c in keep), T.StructField(out_col, ids_type), *([T.StructField(decoded_col, T.BinaryType())] if decoded_col else [])])
    is_long = F.coalesce(F.length(text) > chunk_chars, F.lit(False))
    short = frame.where(~is_long).mapInArrow(whole, schema)
    name = fresh("_key", [*keep, text, *added])
    long = frame.where(is_long).withColumn(name, F.sha2(F.col(text).cast("binary"), 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, whole_text in zip(b.column("_key").to_pylist(), b.column(text).to_pylist(), strict=True):
                n = -(-len(whole_text) // chunk_chars)
                for k in range(n):
                    at = k * chunk_chars
                    yield pa.RecordBatch.from_pylist([{"_key": key, "k": k, "at": at, "last": k == n - 1, "chunk": whole_text[at : at + chunk_chars + overlap]}], schema=pa.schema([("_key", pa.string()), ("k", pa.int32()), ("at", pa.int64()), ("last", pa.bool_()), ("chunk", pa.string())]))

    chunk_schema = "_key string, k int, at long, last boolean, chunk string"
    chunks = long.select(F.col(name).alias("_key"), text).dropDuplicates(["_key"]).mapInArrow(cut, chunk_schema).repartition("_key", "k")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat = encoder(ranks.value, pattern).pattern
        for b in slices(batches, "chunk"):
            heads, tails = [], []
            for at, last, chunk in zip(*(b.column(c).to_pylist() for c in ("at", "last", "chunk")), strict=True):
                found = boundaries(pat, chunk, last)
                heads.append([at + x for x in found if x <= overlap])
                tails.append([at + x for x in found if x >= chunk_chars])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*b.schema.names, "head", "tail"])

    in_text = Window.partitionBy("_key").orderBy("k")
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(in_text)))
    marked = chunks.mapInArrow(mark, f"{chunk_schema}, head array<long>, tail array<long>")
    stitched = marked.select("_key", "k", "at", "chunk", F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(met).alias("meets"))
    # A chunk without a stitch goes with the one before it.
    spans = stitched.withColumn("span", F.max(F.when(F.col("meets").isNotNull(), F.col("k"))).over(in_text)).withColumn("starts", F.when(F.col("span") == F.col("k"), F.col("meets")))
    spans = spans.groupBy("_key", "span").agg(F.min("starts").alias("starts"), F.array_sort(F.collect_list(F.struct("k", "at", "chunk"))).alias("chunks"))
    spans = spans.withColumn("ends", F.lead("starts").over(Window.partitionBy("_key").orderBy("span")))

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks.value, pattern)
        for b in batches:
            for key, span, starts, rows, ends in zip(*(b.column(c).to_pylist() for c in ("_key", "span", "starts", "chunks", "ends")), strict=True):
                body = "".join(x["chunk"][:chunk_chars] for x in rows[:-1]) + rows[-1]["chunk"]
                base = rows[0]["at"]
                ids, fits = enc.ids_upto(body, starts - base, None if ends is None else ends - base)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([span], pa.int32()), lists([ids]), pa.array([fits or ends is None])], names=["_key", "span", "ids", "fits"])

    encoded = spans.mapInArrow(piece, T.StructType([T.StructField("_key", T.StringType()), T.StructField("span", T.IntegerType()), T.StructField("ids", ids_type), T.StructField("fits", T.BooleanType())]))
    encoded = stored(encoded, "pieces")
    astray = encoded.where(~F.col("fits")).select("_key").distinct()
    if not astray.isEmpty():
        # Only such texts are read again, and whole.
        again = long.join(astray.withColumnRenamed("_key", name), name, "left_semi")
        short = short.unionByName(again.select(*keep, text).mapInArrow(whole, schema))
        encoded = encoded.join(astray, "_key", "left_anti")
    joined = encoded.groupBy("_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("span", "ids"))), lambda x: x["ids"])).alias(out_col))
    if decoded_col:
        joined = decode(joined, ranks_path, out_col, decoded_col)
    return short, long.drop(text), joined.withColumnRenamed("_key", name), name


def joined_bytes(table: dict[int, bytes], ids: Iterable[int]) -> bytes:
    """Decoding: the raw bytes of the ids, one after the other."""
    return b"".join(map(table.__getitem__, ids))


def decode(frame: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """frame (or the columns `keep` of it) with the raw bytes of the ids put together,
    binary. Null ids give empty bytes; an id without a rank raises KeyError."""
    keep = [c for c in (frame.columns if keep is None else keep) if c.lower() != out_col.lower()]
    ids = fresh("ids", keep)
    small_batches(frame.sparkSession)
    ranks = frame.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {int(b): base64.b64decode(a) for a, b in (x.split() for x in ranks.value.splitlines() if x)}
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                raw = [joined_bytes(table, x or ()) for x in b.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(raw, pa.binary())], names=[*keep, out_col])
        give_back()

    source = frame.select(*[frame[c] for c in keep], frame[ids_col].alias(ids))
    return source.mapInArrow(join, T.StructType([*(source.schema[c] for c in keep), T.StructField(out_col, T.BinaryType())]))


def ids_digest(ids: str | Column) -> Column:
    """Lowercase hex of the SHA-256 of the decimal ids joined by one space."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")).cast("binary"), 256)


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    short, long, distinct, name = encoded_apart(docs.select("doc_id", "text"), ranks_path, pattern, keep=["doc_id"], decoded_col="decoded")
    digests = [F.size("token_ids").cast("long").alias("n_tokens"), ids_digest("token_ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    # Made before the join, so that no ids and bytes are shuffled to the rows.
    return short.select("doc_id", *digests).unionByName(long.join(distinct.select(name, *digests), name).drop(name))
