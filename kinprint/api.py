"""One object for a folder's workflow: hash, compare, group, project, find, remove."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import hashes
from kinprint.operators import clustering, edit, pairs, projection
from kinprint.sources import media


@dataclass(frozen=True)
class Settings:
    """Run settings, checked when made."""

    algorithm: str = "dhash"
    size: int = 8
    method: str = "threshold"
    threshold: int = 10
    linkage: str = "complete"
    cut_height: int = 10
    min_cluster_size: int = 3
    dims: int = 3

    def __post_init__(self):
        hashes.check_size(self.size)
        if self.algorithm not in hashes.RASTER_HASHES:
            raise ValueError(f"unknown hash {self.algorithm!r}")
        if self.method not in clustering.METHODS:
            raise ValueError(f"method must be one of {clustering.METHODS}")
        if self.linkage not in clustering.LINKAGES:
            raise ValueError(f"linkage must be one of {clustering.LINKAGES}")
        if self.threshold < 0 or self.cut_height < 0 or self.min_cluster_size < 2 or self.dims < 1:
            raise ValueError("thresholds must not be negative, clusters have two members and maps one dimension at least")

    @property
    def n_bits(self) -> int:
        return self.size * self.size


# Size and threshold that go with each hash in the prototype.
PROTOTYPE = {"dhash": (8, 10), "phash": (16, 25), "whash": (8, 10)}


class Library:
    """Hashed files with an index; every result is a DataFrame."""

    def __init__(self, frame: DataFrame, settings: Settings):
        self.frame, self.settings = frame, settings

    @classmethod
    def of_images(cls, spark: SparkSession, folder: str, settings: Settings | None = None) -> Library:
        settings = settings or Settings()
        made = media.hash_images(spark, folder, settings.algorithm, settings.size).filter("words is not null")
        indexed = media.with_index(made.withColumn("kind", F.lit("image"))).drop("kind")
        return cls(indexed, settings)

    def pairs(self) -> DataFrame:
        return pairs.all_pairs(self.frame, self.settings.n_bits)

    def similar(self, threshold: int | None = None) -> DataFrame:
        return pairs.similar_pairs(self.frame, self.settings.n_bits, self.settings.threshold if threshold is None else threshold)

    def members(self) -> DataFrame:
        s = self.settings
        return clustering.cluster(self.frame, s.n_bits, s.method, s.threshold, s.linkage, s.cut_height, s.min_cluster_size)

    def groups(self, min_size: int = 2) -> DataFrame:
        return clustering.group_stats(self.frame, self.members(), self.settings.n_bits, min_size)

    def project(self, method: str = "pca", **options) -> DataFrame:
        return projection.project(self.frame, self.settings.n_bits, method, self.settings.dims, **options)

    def find(self, queries: DataFrame, top: int = 10, threshold: int = -1) -> DataFrame:
        found = pairs.find(self.frame, queries, self.settings.n_bits, top, threshold)
        return found.join(self.frame.select("file_idx", "file"), "file_idx")

    def remove(self, path: str) -> Library:
        return Library(edit.from_hashes(self.frame, edit.index_of(self.frame, path)), self.settings)


def prototype_group(spark: SparkSession, folder: str, algorithm: str = "dhash", size: int | None = None, threshold: int | None = None) -> DataFrame:
    """(file_idx, leader) by greedy leaders; an explicit zero is honoured."""
    default_size, default_threshold = PROTOTYPE[algorithm]
    size = default_size if size is None else size
    threshold = default_threshold if threshold is None else threshold
    library = Library.of_images(spark, folder, Settings("dhash_left" if algorithm == "dhash" else algorithm, size))
    return clustering.greedy(library.frame, size * size, threshold)
