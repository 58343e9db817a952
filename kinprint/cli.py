"""Command line: hash, cluster, project, find and remove over Parquet tables of hashes.

    python -m kinprint.cli hash FOLDER OUT [--algo dhash] [--size 8]
    python -m kinprint.cli cluster HASHES OUT [--method threshold] [--threshold 10] ...
    python -m kinprint.cli project HASHES OUT [--method pca] [--dims 3]
    python -m kinprint.cli find HASHES FILE_IDX [--top 10] [--threshold N] [--json]
    python -m kinprint.cli remove HASHES OUT FILE
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinprint.api import Library, Settings
from kinprint.functions import hashes
from kinprint.operators import clustering
from kinprint.sources import artefacts


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinprint")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for place in places:
            sub.add_argument(place)
        sub.add_argument("--algo", default="dhash", choices=sorted(hashes.RASTER_HASHES))
        sub.add_argument("--size", type=int, default=8)
        return sub

    command("hash", "folder", "out")
    sub = command("cluster", "hashes", "out")
    sub.add_argument("--method", default="threshold", choices=clustering.METHODS)
    sub.add_argument("--threshold", type=int, default=10)
    sub.add_argument("--linkage", default="complete", choices=clustering.LINKAGES)
    sub.add_argument("--cut", type=int, default=10)
    sub.add_argument("--min-group", type=int, default=3)
    sub.add_argument("--min-filter", type=int, default=2)
    sub = command("project", "hashes", "out")
    sub.add_argument("--method", default="pca", choices=("pca", "tsne"))
    sub.add_argument("--dims", type=int, default=3)
    sub = command("find", "hashes")
    sub.add_argument("index", type=int)
    sub.add_argument("--top", type=int, default=10)
    sub.add_argument("--threshold", type=int, default=-1)
    sub.add_argument("--json", action="store_true")
    command("remove", "hashes", "out", "file")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    settings = Settings(
        args.algo, args.size, getattr(args, "method", "threshold") if args.command == "cluster" else "threshold",
        max(0, getattr(args, "threshold", 10)), getattr(args, "linkage", "complete"), getattr(args, "cut", 10),
        getattr(args, "min_group", 3), getattr(args, "dims", 3),
    )
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "hash":
        Library.of_images(spark, args.folder, settings).frame.write.parquet(args.out)
        return 0
    library = Library(spark.read.parquet(args.hashes), settings)
    if args.command == "cluster":
        members = library.members()
        members.write.parquet(f"{args.out}/members")
        library.groups(args.min_filter).write.parquet(f"{args.out}/groups")
    elif args.command == "project":
        library.project(args.method).write.parquet(args.out)
    elif args.command == "remove":
        library.remove(args.file).frame.write.parquet(args.out)
    else:
        query = library.frame.filter(F.col("file_idx") == args.index).select(F.col("file_idx").alias("query"), "words")
        rows = [(r["file"], r["d"]) for r in library.find(query, args.top, args.threshold).orderBy("d", "file_idx").collect()]
        print(artefacts.find_json(rows) if args.json else "\n".join(f"{d}\t{f}" for f, d in rows))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
