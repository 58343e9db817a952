"""Frames of a video: when they are taken, and how their hashes vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.functions import bits

STRATEGIES = ("evenly_spaced",)


def frame_times(videos: DataFrame, n_frames: int = 8, strategy: str = "evenly_spaced") -> DataFrame:
    """(path, frame, t): the middles of equal parts of ``duration``; videos without one give no rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    n = max(1, n_frames)
    frames = videos.filter("duration > 0").select("path", "duration", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("frame"))
    return frames.select("path", "frame", (F.col("duration") / n * (F.col("frame") + 0.5)).alias("t"))


def sample_indices(total: int, n: int) -> list[int]:
    """Evenly spaced frame numbers from the first to the last, each once."""
    if total < 1:
        return []
    if n < 2:
        return [0]
    return sorted({int(k * (total - 1) / (n - 1)) for k in range(n)})


def majority_vote(frames: DataFrame, n_bits: int) -> DataFrame:
    """(path, words, n_frames): a bit is set if more than half (rounded down) of a path's readable frames set it.

    Votes are sums by bit, so they are combined before the shuffle however many frames a path has.
    """
    readable = frames.filter("words is not null")
    each = bits.unpack(F.col("words"), n_bits)
    votes = readable.select("path", *[F.get(each, k).alias(f"b{k}") for k in range(n_bits)]).groupBy("path").agg(
        F.count(F.lit(1)).alias("n_frames"), *[F.sum(f"b{k}").alias(f"b{k}") for k in range(n_bits)]
    )
    half = F.floor(F.col("n_frames") / 2)
    flags = F.array(*[F.when(F.col(f"b{k}") > half, 1).otherwise(0) for k in range(n_bits)])
    return votes.select("path", bits.pack(flags, n_bits).alias("words"), "n_frames")
