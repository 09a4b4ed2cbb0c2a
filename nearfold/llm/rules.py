"""Quality rules by compression bands.

A text is compressed with zstandard as a whole and in fixed chunks. The ratio (compressed
by raw bytes) must lie inside the band that belongs to its length: below it the text
repeats itself, above it the text has no structure. A text is rejected if its whole ratio
is out of band, or if more than `bad_share` of its chunks are out of the chunk band. The
last chunk ends at the text's end, so every byte lies in a full chunk; a text without a
full chunk is judged as a whole. Texts shorter than the first band are never rejected by
compression.

Base counts come with it: words (maximal runs without ASCII white space), their code
points, symbols, lines that repeat an earlier line, words in repeated 3-word windows.

Null texts count as empty. Every row is judged by itself, so ties and repeated rows get
equal results. All columns are kept; an output replaces an input column of its name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfold.llm.common import fresh, slices, small_batches

#: (least bytes, lowest ratio, highest ratio, highest ratio of wide scripts) for whole
#: texts, by length. Longer texts repeat more by chance and pay less for the frame, so the
#: limits fall. The highest ratios stand a little above those of prose (README), those of
#: wide scripts a little below random characters. A row may leave out its last limit.
BANDS = (
    (256, 0.30, 0.80, 0.82),
    (1024, 0.26, 0.70, 0.73),
    (2048, 0.26, 0.585, 0.70),
    (4096, 0.22, 0.525, 0.68),
    (8192, 0.22, 0.49, 0.67),
    (16_384, 0.22, 0.46, 0.67),
    (32_768, 0.18, 0.45, 0.67),
)

#: The band of a full chunk, as in BANDS.
CHUNK_BAND = (0.24, 0.585, 0.70)

#: First bytes of three-byte kana, Han and Hangul and of all four-byte characters.
WIDE = bytes([*range(0xE3, 0xEE), *range(0xF0, 0xF5)])

SYMBOLS = b"#*$%&|<>"

OUTPUT = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_bad_chunks", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def repeated_words(codes: np.ndarray, size: int) -> int:
    """Words that lie in 3-word windows found twice or more. codes: below `size`."""
    n = len(codes) - 2
    if n < 2:
        return 0
    codes = codes.astype(np.int64)
    pairs, base = codes[:-1] * size + codes[1:], size
    if size >= 1 << 20:  # three codes no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1].reshape(-1)
    _, where, counts = np.unique(pairs[:-1] * base + codes[2:], return_inverse=True, return_counts=True)
    again = counts[where.reshape(-1)] >= 2
    marked = np.zeros(len(codes), dtype=bool)
    for shift in range(3):
        marked[shift : shift + n] |= again
    return int(marked.sum())


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text of an array without nulls."""
    n = len(texts)
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]

    def count(members: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(members[raw], dtype=np.int64)))[ends])

    symbol, letter = np.zeros(256, np.uint8), np.ones(256, np.uint8)
    symbol[list(SYMBOLS)] = 1
    letter[0x80:0xC0] = 0  # continuation bytes
    letter[[0x20, *range(0x09, 0x0E)]] = 0

    split = pc.ascii_split_whitespace(texts)
    owner, words = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    real = pc.greater(pc.binary_length(words), 0)
    owner, words = owner[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
    n_words = np.bincount(owner, minlength=n)
    codes, at = words.indices.to_numpy(), np.concatenate(([0], np.cumsum(n_words)))
    again = [repeated_words(codes[at[i] : at[i + 1]], len(words.dictionary)) for i in range(n)]

    split = pc.split_pattern(texts, "\n")
    owner, lines = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
    worded = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    owner, lines = owner[worded.to_numpy(zero_copy_only=False)].astype(np.int64), lines.filter(worded).dictionary_encode()
    size = max(1, len(lines.dictionary))
    first = np.unique(owner * size + lines.indices.to_numpy()) // size
    n_dup = np.bincount(owner, minlength=n) - np.bincount(first, minlength=n)

    return {"n_words": n_words, "word_chars": count(letter), "n_symbols": count(symbol), "n_dup_lines": n_dup, "n_repeat_words": np.array(again, dtype=np.int64)}


def limits(size: int, bands) -> tuple[float, ...] | None:
    """The band for a text of so many bytes."""
    found = None
    for least, *band in bands:
        if size >= least:
            found = tuple(band)
    return found


def within(raw: bytes, ratio: float, band: Sequence[float]) -> bool:
    """Whether a text's ratio lies in its band. The upper limit moves from the common to
    the wide one with the share of bytes in wide scripts."""
    wide = min(1.0, 3 * (len(raw) - len(raw.translate(None, WIDE))) / len(raw))
    return band[0] <= ratio <= band[1] + wide * (band[-1] - band[1])


def compression_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, bands=BANDS, chunk_band=CHUNK_BAND, chunk_bytes: int = 2048, bad_share: float = 0.1, level: int = 3) -> DataFrame:
    """docs (or the columns `keep` of it) with the columns of OUTPUT. ratio is null for
    texts without bytes."""
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUTPUT.names]
    text = fresh("body", keep)
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(text))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        for b in slices(batches, text):
            texts = pc.fill_null(b.column(text), "")
            out = base_counts(texts)
            ratios, chunks, bads, fine = [], [], [], []
            for raw in texts.cast(pa.binary()).to_pylist():
                ratio = len(compress(raw)) / len(raw) if raw else None
                band = limits(len(raw), bands)
                full = -(-len(raw) // chunk_bytes) if len(raw) >= chunk_bytes else 0
                starts = (min(i * chunk_bytes, len(raw) - chunk_bytes) for i in range(full))
                parts = (raw[a : a + chunk_bytes] for a in starts)
                bad = sum(not within(x, len(compress(x)) / chunk_bytes, chunk_band) for x in parts)
                ratios.append(ratio)
                chunks.append(full)
                bads.append(bad)
                fine.append((band is None or within(raw, ratio, band)) and bad <= bad_share * full)
            failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            columns = [*(out[c].astype(np.int64) for c in OUTPUT.names[:5]), pa.array(ratios, pa.float64()), np.array(chunks, np.int64), np.array(bads, np.int64), failed, ~failed & np.array(fine, bool)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(x) for x in columns)], names=[*keep, *OUTPUT.names])

    return source.mapInArrow(judge, T.StructType([*(source.schema[c] for c in keep), *OUTPUT]))
