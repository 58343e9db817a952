"""Media files as rows: scans, gray rasters, fingerprints.

Scans read paths only (the content column is pruned) and order files by path, images before videos.
Pictures are decoded by Spark's own image reader; a picture that it can't read gives no
fingerprint. Videos need an outside frame reader, which is a parameter.
"""

from __future__ import annotations

import functools
import json
import math
import subprocess

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import bits, hashes, text
from kinprint.operators.clustering import dense_index


def scan(spark: SparkSession, folder: str, media: str = "images", recursive: bool = True) -> DataFrame:
    """(file, kind, size) of images, videos or all."""
    if media not in ("images", "videos", "all"):
        raise ValueError("media must be images, videos or all")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.col("path")
    kind = F.when(text.is_image(path), "image").when(text.is_video(path), "video")
    rows = found.select(path.alias("file"), kind.alias("kind"), F.col("length").alias("size")).filter("kind is not null")
    return rows if media == "all" else rows.filter(F.col("kind") == media[:-1])


def with_index(files: DataFrame) -> DataFrame:
    """``files`` with file_idx: images by path, then videos by path."""
    ordered = files.withColumn("__order", F.struct((F.col("kind") == "video").alias("v"), "file"))
    return dense_index(ordered, "__order", "file_idx").drop("__order")


def _kernel(x: np.ndarray, b: float, c: float) -> np.ndarray:
    """The Mitchell-Netravali family of cubic filters."""
    x = np.abs(x)
    near = ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
    far = ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@functools.lru_cache(64)
def resize_matrix(source: int, target: int) -> np.ndarray:
    """Weights of one axis: Catmull-Rom when enlarging, Mitchell when reducing; edges are repeated."""
    scale = source / target
    width = max(1.0, scale)
    b, c = (0.0, 0.5) if target >= source else (1 / 3, 1 / 3)
    out = np.zeros((target, source))
    for k in range(target):
        centre = (k + 0.5) * scale
        lo, hi = math.floor(centre - 2 * width), math.ceil(centre + 2 * width)
        at = np.arange(lo, hi + 1)
        w = _kernel((at + 0.5 - centre) / width, b, c)
        np.add.at(out[k], np.clip(at, 0, source - 1), w / w.sum())
    return out


def resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """8-bit gray picture of another size."""
    if gray.shape == (height, width):
        return gray
    made = resize_matrix(gray.shape[0], height) @ gray.astype(float) @ resize_matrix(gray.shape[1], width).T
    return np.clip(np.floor(made + 0.5), 0, 255).astype(np.uint8)


def gray_of(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Integer luma of a picture in rows of blue, green, red (and alpha); one channel is gray already."""
    raster = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels < 3:
        return raster[:, :, 0]
    blue, green, red = (raster[:, :, k].astype(np.int32) for k in range(3))
    return ((red * 77 + green * 150 + blue * 29) >> 8).astype(np.uint8)


def hash_images(spark: SparkSession, folder: str, algorithm: str = "dhash", size: int = 8, recursive: bool = True) -> DataFrame:
    """(file, words): the fingerprint of every readable image."""
    hashes.check_size(size)
    if algorithm not in hashes.RASTER_HASHES:
        raise ValueError(f"unknown hash {algorithm!r}")
    make, shape = hashes.RASTER_HASHES[algorithm]
    width, height = shape(size)
    words_of = hashes.words_of

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                gray = resize(gray_of(r.data, r.width, r.height, r.channels), width, height)
                out.append(words_of(make(gray, size)))
            yield pd.DataFrame({"file": pdf["file"], "words": out})

    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = images.filter(text.is_image(F.col("image.origin"))).select(
        F.col("image.origin").alias("file"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )
    return rows.mapInPandas(run, "file string, words array<long>")


def probe(paths: DataFrame, command: str = "ffprobe") -> DataFrame:
    """(path, duration): seconds by an outside program; 0.0 where it is missing or fails."""

    def run(batches):
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    said = subprocess.run(
                        [command, "-v", "error", "-show_entries", "format=duration", "-of", "json", path.removeprefix("file:")],
                        capture_output=True, timeout=60, check=True,
                    ).stdout
                    out.append(float(json.loads(said)["format"]["duration"]))
                except (OSError, subprocess.SubprocessError, ValueError, KeyError):
                    out.append(0.0)
            yield pd.DataFrame({"path": pdf["path"], "duration": out})

    return paths.select("path").mapInPandas(run, "path string, duration double")


def video_info(raw: DataFrame) -> DataFrame:
    """(path, duration, fps, width, height): failures are zeros, frame rates lie in 1 to 120."""
    ok = F.col("duration") > 0
    value = lambda c: F.when(ok, F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    fps = F.when(ok, F.greatest(F.lit(1.0), F.least(F.lit(120.0), F.coalesce("fps", F.lit(0.0))))).otherwise(0.0)
    return raw.select("path", value("duration").cast("double").alias("duration"), fps.alias("fps"), value("width").alias("width"), value("height").alias("height"))


def hash_frames(frames: DataFrame, read_frame, algorithm: str = "dhash", size: int = 8) -> DataFrame:
    """(path, frame, words) of (path, frame, t); ``read_frame(path, t)`` gives a gray raster, or None."""
    make, shape = hashes.RASTER_HASHES[algorithm]
    width, height = shape(size)
    words_of = hashes.words_of

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                gray = read_frame(r.path, r.t)
                out.append(None if gray is None else words_of(make(resize(gray, width, height), size)))
            yield pd.DataFrame({"path": pdf["path"], "frame": pdf["frame"], "words": out})

    return frames.select("path", "frame", "t").mapInPandas(run, "path string, frame int, words array<long>")


def move_plan(members: DataFrame, files: DataFrame, out: str) -> DataFrame:
    """(src, dst) for files of groups of two or more: group_1, group_2, ... in group order. Nothing is moved."""
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    numbered = dense_index(sizes.select("leader"), "leader", "k")
    placed = members.join(numbered, "leader").join(files.select("file_idx", "file"), "file_idx")
    target = F.concat(F.lit(out.rstrip("/") + "/group_"), (F.col("k") + 1).cast("string"), F.lit("/"), text.file_name(F.col("file")))
    return placed.select(F.col("file").alias("src"), target.alias("dst"))


def restore_plan(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def to_hash_rows(frame: DataFrame, n_bits: int) -> DataFrame:
    return frame.select("file", bits.to_hex(F.col("words"), n_bits).alias("hash"))
