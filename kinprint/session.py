"""Session helpers that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark touches the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one in ``spark.checkpoint.dir``. Only where that is unset and all runs on one
    machine, as in tests, a temporary folder is set in its place.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinprint-checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage.

    A written table: ``checkpoint()`` would compute the rows twice, once to count and once to store.
    """
    return written(df, "cut")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It survives lost executors as a checkpoint does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A name that no column of ``df`` has or begins with, in any letter case; names made from it are free too."""
    taken = [c.lower() for c in df.columns]
    name, k = f"__{base}", 0
    while any(c.startswith(name.lower()) for c in taken):
        k += 1
        name = f"__{base}{k}x"
    return name
