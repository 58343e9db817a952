"""Fingerprints of files as they arrive: a file stream, hashed batch by batch into a Parquet table."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from kinprint.functions import text


def new_media(spark: SparkSession, folder: str) -> DataFrame:
    """(file, modified, content) of arriving images."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return files.filter(text.is_image(F.col("path"))).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "content")


def hash_stream(stream: DataFrame, make_words, target: str, checkpoint: str):
    """Append (file, modified, words) for each new row; ``make_words`` is a column function of ``content``.

    A batch is written under its number, so a batch that is run again replaces itself.
    """
    hashed = stream.select("file", "modified", make_words(F.col("content")).alias("words")).filter("words is not null")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return hashed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
