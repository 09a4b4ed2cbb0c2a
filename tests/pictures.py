"""PNG files made from formulas, written with the standard library."""

import struct
import zlib

import numpy as np


def png(path, pixels):
    """pixels: (height, width), or (height, width, 3 or 4), bytes."""
    pixels = np.asarray(pixels, np.uint8)
    height, width = pixels.shape[:2]
    kind = {2: 0, 3: {3: 2, 4: 6}.get(pixels.shape[-1])}[pixels.ndim]
    raw = b"".join(b"\0" + row.tobytes() for row in pixels)

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def scene(seed, size=96, colour=True):
    """A smooth picture of a few waves; the same seed gives the same picture at any size."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size] / size
    out = np.zeros((size, size, 3))
    for _ in range(6):
        a, b, c = rng.uniform(-9, 9, 3)
        wave = np.sin(a * x + b * y + c)
        out += wave[:, :, None] * (rng.uniform(-1, 1, 3) if colour else rng.uniform(-1, 1))
    low, high = out.min(), out.max()
    return ((out - low) / (high - low) * 255).astype(np.uint8)


def touched(pixels, amount=3):
    """The picture with a little noise."""
    noise = np.random.default_rng(1).integers(-amount, amount + 1, pixels.shape)
    return np.clip(pixels.astype(int) + noise, 0, 255).astype(np.uint8)
