"""Taking one file out of hashes, pairs, groups and projections without computing them anew.

Indices above the file's move down by one. Groups keep their numbers; one that has fewer than
``min_keep`` members left is dissolved and its rest is ungrouped. Nothing is clustered again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_of(hashes: DataFrame, path: str) -> int:
    """The first index of a path; an unknown path raises KeyError."""
    found = hashes.filter(F.col("file") == path).agg(F.min("file_idx")).first()[0]
    if found is None:
        raise KeyError(path)
    return found


def _moved(column: Column, index: int) -> Column:
    return F.when(column > index, column - 1).otherwise(column)


def from_hashes(hashes: DataFrame, index: int) -> DataFrame:
    return hashes.filter(F.col("file_idx") != index).withColumn("file_idx", _moved(F.col("file_idx"), index))


def from_pairs(pairs: DataFrame, index: int) -> DataFrame:
    kept = pairs.filter((F.col("i") != index) & (F.col("j") != index))
    return kept.withColumn("i", _moved(F.col("i"), index)).withColumn("j", _moved(F.col("j"), index))


def from_groups(members: DataFrame, index: int, min_keep: int = 2) -> DataFrame:
    """(file_idx, group) after removal; members of dissolved groups have a null group."""
    kept = from_hashes(members, index)
    sizes = kept.filter("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("__n"))
    joined = kept.join(sizes, "group", "left")
    # A group that was single all along is ungrouped already; only real groups are dissolved.
    return joined.withColumn("group", F.when(F.col("__n") >= min_keep, F.col("group"))).drop("__n")


def from_projection(points: DataFrame, index: int) -> DataFrame:
    return from_hashes(points, index)
