"""Sets of word shingles as sorted 64-bit hashes, whole batches at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed odd multipliers of the hashes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)

#: Bytes of text whose words are hashed at once.
PIECE = 1 << 17

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX
    h = (h ^ (h >> np.uint64(29))) * STEP
    return h ^ (h >> np.uint64(32))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) of the texts,
    and how many each text has. Nulls count as empty."""
    n = len(texts)
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    word = _WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = ends[:-1]
    at = at[at < len(raw)]
    first[at] = word[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    owner = np.searchsorted(ends, starts, side="right") - 1
    # Some words at a time: what is worked out for every byte takes many times its size.
    cuts = np.searchsorted(starts, np.arange(0, len(raw), PIECE))
    cuts = np.unique(np.append(cuts, (0, len(starts))))
    sums = np.empty(len(starts), np.uint64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        begin, end = starts[low], starts[high] if high < len(starts) else len(raw)
        used = np.flatnonzero(word[begin:end])
        place = used - (starts[low:high] - begin)[np.cumsum(first[begin:end][used]) - 1]
        part = (_LOWER[raw[begin:end][used]].astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
        sums[low:high] = np.add.reduceat(part, np.searchsorted(used, starts[low:high] - begin))
    return mixed(sums), np.bincount(owner, minlength=n)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words; of the
    whole sequence, if it has fewer words; none without words."""
    hashes, counts = word_hashes(texts)
    n = len(hashes) - size + 1
    if n > 0:
        whole = np.zeros(n, np.uint64)
        for j, p in enumerate(powers(size + 1)[1:]):
            whole += hashes[j : j + n] * p
        whole = mixed(whole)
    out, at = [], 0
    for c in counts:
        if c >= size:
            out.append(np.unique(whole[at : at + c - size + 1]))
        elif c:
            short = np.uint64(c) + (hashes[at : at + c] * powers(c + 2)[2:]).sum(dtype=np.uint64)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def digest(grams: np.ndarray) -> bytes:
    """Of a set: equal sets, and only they, have equal digests."""
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
