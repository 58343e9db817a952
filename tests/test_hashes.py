import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinprint.functions import bits, hashes, text


def test_dhash_of_a_hand_made_grid(spark):
    df = spark.createDataFrame([([9, 5, 7, 1, 2, 2],), ([1, 2],), (None,)], "g array<int>")
    rows = df.select(hashes.dhash_bits(F.col("g"), 2).alias("b"), hashes.dhash(F.col("g"), 2).alias("w")).collect()
    assert rows[0]["b"] == [1, 0, 0, 0] and rows[0]["w"] == [0b1000 << 28]
    assert rows[1]["w"] is None and rows[2]["w"] is None
    rising = df.limit(1).select(hashes.dhash_bits(F.col("g"), 2, rising=True)).first()[0]
    assert rising == [0, 1, 1, 0]


def test_transforms_against_definitions():
    x = np.random.default_rng(0).normal(size=8)
    want = [sum(x[n] * math.cos(math.pi / 8 * (n + 0.5) * k) for n in range(8)) for k in range(8)]
    assert np.allclose(hashes.cosine_matrix(8) @ x, want)
    h = hashes.haar_matrix(8)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(h @ np.ones(8), [math.sqrt(8)] + [0] * 7)
    row, out = list(x), []
    while len(row) > 1:
        out = [(a - b) / math.sqrt(2) for a, b in zip(row[::2], row[1::2])] + out
        row = [(a + b) / math.sqrt(2) for a, b in zip(row[::2], row[1::2])]
    assert np.allclose(h @ x, row + out)


def test_flat_grids():
    flat = np.full((32, 32), 128.0)
    assert hashes.transform_bits(flat, hashes.cosine_matrix(32), 8).tolist() == [1] + [0] * 63
    assert hashes.transform_bits(flat[:16, :16], hashes.haar_matrix(16), 8).tolist() == [1] + [0] * 63


def test_shapes_and_errors():
    assert hashes.raster_shape("dhash", 8) == (9, 8) and hashes.raster_shape("phash", 4) == (32, 32)
    assert hashes.raster_shape("whash", 4) == (8, 8) and hashes.raster_shape("whash", 9) == (32, 32)
    for bad in (("dhash", 1), ("dhash", 2000), ("other", 8)):
        with pytest.raises(ValueError):
            hashes.raster_shape(*bad)


@pytest.mark.parametrize("n", [4, 16, 49, 64, 100])
def test_packing_hex_bands_and_distance(spark, n):
    rng = np.random.default_rng(n)
    rows = [([int(v) for v in rng.integers(0, 2, n)], [int(v) for v in rng.integers(0, 2, n)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", bits.pack(F.col("a"), n).alias("x"), bits.pack(F.col("b"), n).alias("y"))
    got = df.select(
        "a", "b", bits.unpack(F.col("x"), n).alias("u"), bits.to_hex(F.col("x"), n).alias("h"), bits.hamming(F.col("x"), F.col("y"), n).alias("d"),
        (bits.from_hex(bits.to_hex(F.col("x"), n), n) == F.col("x")).alias("same"), bits.band(F.col("x"), 1, n - 2).alias("mid"),
    ).collect()
    for r in got:
        padded = r["a"] + [0] * (-n % 8)
        assert r["u"] == r["a"] and r["same"] and r["d"] == sum(p != q for p, q in zip(r["a"], r["b"]))
        assert r["h"] == bytes(int("".join(map(str, padded[k : k + 8])), 2) for k in range(0, len(padded), 8)).hex()
        if n <= 64:
            assert r["mid"] == int("".join(map(str, r["a"][1:-1])), 2)


def test_hex_of_a_wrong_size_is_null(spark):
    df = spark.createDataFrame([("ffff",), ("ff",), ("zzzz",), (None,)], "h string")
    assert [r[0] for r in df.select(bits.from_hex(F.col("h"), 16)).collect()] == [[0xFFFF0000], None, None, None]


def test_luma_and_display_helpers(spark):
    df = spark.createDataFrame([("/a/b/C.PNG", 61.5)], "p string, s double")
    r = df.select(
        text.extension(F.col("p")).alias("e"), text.is_image(F.col("p")).alias("i"), text.is_video(F.col("p")).alias("v"), text.file_name(F.col("p")).alias("n"),
        text.parent(F.col("p")).alias("d"), text.duration(F.col("s")).alias("t"), text.byte_size(F.lit(2048)).alias("z"), text.palette_index(F.lit(23)).alias("c"),
        hashes.luma(F.lit(255), F.lit(255), F.lit(255)).alias("l"), text.progress(F.lit("x: progress 3/10")).alias("g"), text.ago(F.lit(120)).alias("a"),
    ).first()
    assert (r["e"], r["i"], r["v"], r["n"], r["d"]) == ("png", True, False, "C.PNG", "/a/b")
    assert (r["t"], r["z"], r["c"], r["l"], tuple(r["g"]), r["a"]) == ("1:01.500", "2.0 KB", 3, 255, (3, 10), "2 min")
