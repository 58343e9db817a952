"""The queries of the ten operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinprint.llm import chat, ctw, decontaminate, langid, mixing, quality, simhash, suffixes, tokenbin, warc
from kinprint.session import table


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies; imported late, as only two queries need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame, q = quality.with_quality(table(spark, sf_dir, "documents"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept failed".split()
    return frame.select("doc_id", *[F.col(q)[c].alias(c) for c in names])


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.score(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").withColumnRenamed("held", "held_out")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return warc.summaries(made).withColumnRenamed("key", "page_id")


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, m = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.round(F.col(m)["rate"], 9).alias("rate"),
        *[F.col(m)[c].alias(c) for c in ("copies", "copy", "order_key")],
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.round("score", 6).alias("score"), "end_word", "n_seeds")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tokenbin.store(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return tokenbin.read_documents(stored).withColumnRenamed("id", "doc_id")


def op8_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_planted(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_chats(rows, tokenizer_path("byte_bpe_50k.json")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learn(docs.filter("not held_out"))
    found = langid.identify(docs, model, carry=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", F.col("lang").alias("lang_pred"), "score", F.size("spans").alias("n_spans"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_context_tree": op2_context_tree,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_poisson_mixing": op4_poisson_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_chat_masks": op8_chat_masks,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.oracle_sql(),
    "op4_poisson_mixing": mixing.oracle_sql(),
}
