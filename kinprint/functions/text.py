"""Small display helpers as columns: durations, sizes, ages, path parts, palette."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media extensions.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tga", "gif")
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "ts", "flv", "wmv")
PALETTE_SIZE = 20


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+/*$", 1)


def palette_index(group: Column) -> Column:
    return F.pmod(group, F.lit(PALETTE_SIZE))


def duration(seconds: Column) -> Column:
    """M:SS.mmm"""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / 1024**2))
    )


def ago(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.lit("just now"))
        .when(seconds < 3600, F.format_string("%d min", F.floor(seconds / 60)))
        .when(seconds < 86400, F.format_string("%d h", F.floor(seconds / 3600)))
        .otherwise(F.format_string("%d d", F.floor(seconds / 86400)))
    )


def progress(line: Column) -> Column:
    """(done, total) of a line that has N/TOTAL; null otherwise."""
    part = lambda k: F.regexp_extract(line, r"(\d+)\s*/\s*(\d+)", k).cast("long")
    return F.when(line.rlike(r"\d+\s*/\s*\d+"), F.struct(part(1).alias("done"), part(2).alias("total")))
