"""Perceptual hash and grayscale test over decoded images, Arrow batches at a time.

The hash is the published DCT hash: luma, reduced to SIDE x SIDE by area, two-dimensional
DCT-II, the KEPT x KEPT lowest frequencies, a bit for each coefficient above their median.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, KEPT = 32, 8

#: Fixed values of the grayscale test: a pixel is coloured from this difference of two
#: channels on; so many pixels of the whole image allow for one coloured sample.
COLOURED, PIXELS_FOR_ONE = 32, 1024

ImageHash = Callable[[np.ndarray], int]


def cosines() -> np.ndarray:
    k = np.arange(KEPT)[:, None]
    return np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * k / (2 * SIDE))


COSINES = cosines()


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """(height, width, 3) in the order blue, green, red; alpha is left out."""
    flat = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    return np.repeat(flat, 3, axis=2) if channels == 1 else flat[:, :, :3]


def shares(n: int) -> np.ndarray:
    """(SIDE, n): how much of each of n cells falls in each of SIDE equal parts."""
    edges = np.arange(SIDE + 1) * n / SIDE
    cells = np.arange(n)
    low = np.maximum(edges[:-1, None], cells[None, :])
    high = np.minimum(edges[1:, None], cells[None, :] + 1)
    return np.clip(high - low, 0, None) * SIDE / n


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits as a signed number; the first coefficient is the highest bit."""
    luma = image.astype(np.float64) @ np.array([0.114, 0.587, 0.299])
    small = shares(luma.shape[0]) @ luma @ shares(luma.shape[1]).T
    low = np.round(COSINES @ small @ COSINES.T, 6).reshape(-1)
    bits = low > np.median(low)
    return int(np.packbits(bits).view(">i8")[0])


def is_grayscale(image: np.ndarray) -> bool:
    """Every second pixel of every second row is looked at."""
    sample = image[::2, ::2].astype(np.int16)
    coloured = (sample.max(axis=2) - sample.min(axis=2) >= COLOURED).sum()
    return bool(coloured < image.shape[0] * image.shape[1] // PIXELS_FOR_ONE)


def _over(images: pd.DataFrame, f: Callable[[np.ndarray], object]) -> list:
    columns = (images[c] for c in ("data", "height", "width", "nChannels"))
    return [f(pixels(*row)) for row in zip(*columns, strict=True)]


def looked_at(image: Column, hash_fn: ImageHash = perceptual_hash) -> Column:
    """hash and is_grayscale of an image column, in one pass over its pixels. hash_fn:
    pixels to a signed 64-bit number."""

    @F.pandas_udf(T.StructType([T.StructField("hash", T.LongType()), T.StructField("is_grayscale", T.BooleanType())]))
    def run(images: pd.DataFrame) -> pd.DataFrame:
        found = _over(images, lambda x: (hash_fn(x), is_grayscale(x)))
        return pd.DataFrame({"hash": pd.Series([h for h, _ in found], dtype="int64"), "is_grayscale": pd.Series([g for _, g in found], dtype="bool")})

    return run(image)
