"""JSON artefacts of other tools (hashes, groups, projections), and Parquet as our own.

Readers have fixed schemas; the file map is read as a map and exploded. JSON is properly escaped, and
numbers keep full precision. The JSON writers put one document together on the driver, since a
JSON document is one value; large results belong in Parquet.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.functions import bits

HASHES = "algorithm string, hash_size int, hash_bits int, files map<string,string>"
GROUPS = (
    "algorithm string, hash_size int, hash_bits int, method string, params map<string,string>, files array<string>, "
    "distance_matrix array<array<int>>, dendrogram array<struct<step:int,merged:array<int>,distance:int>>, "
    "membership array<struct<file:int,group:int,confidence:double>>, "
    "condensed_tree array<struct<parent:int,child:int,lambda:double,child_size:int>>, "
    "groups array<struct<id:int,members:array<int>,member_files:array<string>,max_internal_distance:int,avg_internal_distance:double>>, "
    "ungrouped array<int>, stats struct<total_files:int,total_groups:int,total_ungrouped:int,min_distance:int,max_distance:int,avg_distance:double>"
)
PROJECTION = (
    "algorithm string, hash_size int, hash_bits int, method string, dims int, files array<string>, "
    "points array<array<double>>, variance_explained array<double>"
)


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_hashes(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """((file_idx, file, words), settings); files are numbered by path. A document without files raises ValueError."""
    doc = _document(spark, path, HASHES)
    head = doc.first()
    if head is None or head["files"] is None:
        raise ValueError("no files in the document")
    n_bits = head["hash_bits"] or head["hash_size"] ** 2
    rows = doc.select(F.posexplode(F.sort_array(F.map_entries("files"))).alias("file_idx", "e"))
    frame = rows.select(F.col("file_idx").cast("long").alias("file_idx"), F.col("e.key").alias("file"), bits.from_hex(F.col("e.value"), n_bits).alias("words"))
    return frame, {"algorithm": head["algorithm"], "hash_size": head["hash_size"], "hash_bits": n_bits}


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, GROUPS)


def read_projection(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, PROJECTION)


def hashes_json(hashes: DataFrame, algorithm: str, size: int) -> str:
    rows = hashes.select("file", bits.to_hex(F.col("words"), size * size).alias("h"), "file_idx").orderBy("file_idx").toLocalIterator()
    return json.dumps({"algorithm": algorithm, "hash_size": size, "hash_bits": size * size, "files": {r["file"]: r["h"] for r in rows}}, ensure_ascii=False, indent=2)


def groups_json(files: list[str], matrix: list[list[int]], members: list[tuple[int, int]], algorithm: str, size: int, method: str,
                params: dict, min_filter: int = 2, more: dict | None = None) -> str:
    """``members``: (index, group number); groups below ``min_filter`` are listed as ungrouped, once."""
    by: dict[int, list[int]] = {}
    for index, group in sorted(members):
        by.setdefault(group, []).append(index)
    groups, loose = [], []
    for group, own in sorted(by.items()):
        if group < 0 or len(own) < min_filter:
            loose += own
            continue
        inner = [matrix[a][b] for k, a in enumerate(own) for b in own[k + 1 :]]
        groups.append(
            {
                "id": group, "members": own, "member_files": [files[k] for k in own],
                "max_internal_distance": max(inner, default=0), "avg_internal_distance": sum(inner) / len(inner) if inner else 0.0,
            }
        )
    every = [matrix[a][b] for a in range(len(files)) for b in range(a + 1, len(files))]
    doc = {
        "algorithm": algorithm, "hash_size": size, "hash_bits": size * size, "method": method, "params": params, "files": files,
        "distance_matrix": matrix, **(more or {}), "groups": groups, "ungrouped": sorted(loose),
        "stats": {
            "total_files": len(files), "total_groups": len(groups), "total_ungrouped": len(loose), "min_distance": min(every, default=0),
            "max_distance": max(every, default=0), "avg_distance": sum(every) / len(every) if every else 0.0,
        },
    }
    return json.dumps(doc, ensure_ascii=False)


def projection_json(files: list[str], points: list[list[float]], algorithm: str, size: int, method: str, shares: list[float] | None = None) -> str:
    doc = {
        "algorithm": algorithm, "hash_size": size, "hash_bits": size * size, "method": method,
        "dims": len(points[0]) if points else 0, "files": files, "points": points,
    }
    if shares is not None:
        doc["variance_explained"] = shares
    return json.dumps(doc, ensure_ascii=False)


def find_json(rows: list[tuple[str, int]]) -> str:
    return json.dumps([{"file": f, "distance": d} for f, d in rows], ensure_ascii=False)


def find_text(found: DataFrame) -> DataFrame:
    return found.select(F.concat_ws("\t", F.col("d").cast("string"), "file").alias("line"))


def cache_key(folder: str) -> str:
    return hashlib.md5(folder.encode()).hexdigest()


def save_cache(root: str, folder: str, **frames: DataFrame) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{root}/{cache_key(folder)}/{name}")


def load_cache(spark: SparkSession, root: str, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{cache_key(folder)}/{n}") for n in names}
