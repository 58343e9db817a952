"""From raw documents to token shards, in five stages of ``kinprint.llm`` operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinprint.llm import decontaminate, mixing, quality, simhash, tokenbin
from kinprint.llm.registry import tokenizer_path
from kinprint.session import table, written

#: Tokens of the mix stay as many as its documents have, dealt to the sources by weight.
EPOCHS = 1.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their sources' target weights, in a random global order."""
    mixed, _ = mixing.replicate(docs, epochs=EPOCHS)
    return mixed.select(*docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Grammar-compressed shards, written and read back: doc_id, start, n_tokens, ids_crc32."""
    stored = tokenbin.store(docs, tokenizer_path("word_bpe_49k.json"))
    return tokenbin.read_documents(stored).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_shards),
]

#: Fingerprints, alignments and the tokenizer's ids are beyond SQL; tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
