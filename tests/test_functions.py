import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfold.functions import paths, pixels
from nearfold.functions.similarity import hamming, hash_hex, max_distance, percent, ratio
from nearfold.functions.simhash import simhash
from tests.pictures import scene, touched

#: The distance that each bar admits.
TABLE = {85: 10, 90: 6, 91: 6, 92: 5, 93: 4, 94: 4, 95: 3, 96: 3, 97: 2, 98: 1, 99: 1, 100: 0, 0: 64}


def test_bars():
    assert {bar: max_distance(bar) for bar in TABLE} == TABLE
    assert max_distance(101) < 0 and max_distance(150) < 0


def test_hamming_ratio_hex(spark):
    rows = [(0, -1), (5, -1), (5, 5), (1, 2), (-(1 << 63), 0)]
    out = spark.createDataFrame(rows, "a long, b long").select(hamming(F.col("a"), F.col("b")).alias("d"), hash_hex(F.col("b")).alias("x")).collect()
    assert [r["d"] for r in out] == [64, 62, 0, 2, 1]
    assert [r["x"] for r in out] == ["F" * 16, "F" * 16, "5", "2", "0"]
    row = spark.range(1).select(ratio(F.lit(2)).alias("r")).select("r", percent(F.col("r")).alias("p")).first()
    assert row["r"] == 62 / 64 and row["p"] == "96.88%"


def test_path_rules(spark):
    rows = ["/a/x.PNG", "/a/x", "/a.b/x", "/a/.png", "/a/x.gif", "/a/.trash/x.png", "/a/foo.trash/x.png", "/a/.trash/sub/x.png", "/a/x.tar.jpg"]
    c = F.col("p")
    out = spark.createDataFrame([(r,) for r in rows], "p string").select(paths.extension(c).alias("e"), paths.in_trash(c).alias("t"), paths.has_extension(c, [".png", "JPG"]).alias("k"), paths.file_name(c).alias("n")).collect()
    assert [r["e"] for r in out] == ["png", "", "", "png", "gif", "png", "png", "png", "jpg"]
    assert [r["t"] for r in out] == [False] * 5 + [True, True, False, False]
    assert [r["k"] for r in out] == [True, False, False, True, False, True, True, True, True]
    assert out[8]["n"] == "x.tar.jpg"


def test_targets_stay_below_the_root(spark):
    rows = [("/src/a/b.png",), ("/src2/c.png",), ("/elsewhere/d.png",)]
    out = [r[0] for r in spark.createDataFrame(rows, "p string").select(paths.under("/dst/", F.col("p"), "/src")).collect()]
    assert out == ["/dst/a/b.png", "/dst/c.png", "/dst/d.png"]


def gray(height, width, n=0, by=32):
    image = np.full((height, width, 3), 100, np.uint8)
    for i in range(n):
        image[2 * (2 * i // width), 2 * i % width, 1] += by
    return image


@pytest.mark.parametrize(
    ("image", "want"),
    [
        (gray(31, 31), False),  # 961 pixels allow for no sample, and none is not fewer than none
        (gray(32, 32), True),
        (gray(32, 32, 1), False),
        (gray(32, 32, 1, 31), True),
        (gray(64, 64, 3), True),
        (gray(64, 64, 4), False),
    ],
)
def test_grayscale(image, want):
    assert pixels.is_grayscale(image) is want


def test_grayscale_looks_at_every_second_pixel_of_every_second_row():
    image = gray(64, 64)
    image[1::2, :, 0] = 255
    image[:, 1::2, 2] = 255
    assert pixels.is_grayscale(image)


def test_channels():
    one = bytes(range(6))
    assert pixels.pixels(one, 2, 3, 1).shape == (2, 3, 3)
    four = bytes(range(16))
    assert pixels.pixels(four, 2, 2, 4)[0, 1].tolist() == [4, 5, 6]


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_perceptual_hash_relations():
    base = pixels.perceptual_hash(scene(1, 96))
    assert base == pixels.perceptual_hash(scene(1, 96))
    assert distance(base, pixels.perceptual_hash(scene(1, 200))) <= 4
    assert distance(base, pixels.perceptual_hash(touched(scene(1, 96)))) <= 4
    assert min(distance(base, pixels.perceptual_hash(scene(i, 96))) for i in range(2, 12)) > 10
    assert -(1 << 63) <= base < 1 << 63
    assert pixels.perceptual_hash(np.zeros((1, 1, 3), np.uint8)) == pixels.perceptual_hash(np.zeros((50, 7, 3), np.uint8))


def test_simhash_equals_plain_python(spark):
    import hashlib

    texts = ["a b c", "A  b", "", "été word word", "x" * 50]

    def plain(text):
        votes = [0] * 64
        for token in text.lower().split(" "):
            h = int(hashlib.md5(token.encode()).hexdigest()[:16], 16)
            for i in range(64):
                votes[i] += 1 if h >> (63 - i) & 1 else -1
        value = int("".join("1" if v > 0 else "0" for v in votes), 2)
        return value - (1 << 64) if value >> 63 else value

    out = {r["k"]: r["hash"] for r in simhash(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t").collect()}
    assert out == {i: plain(t) for i, t in enumerate(texts)}
