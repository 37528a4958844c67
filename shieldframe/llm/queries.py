"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shieldframe.llm import chat, decontam, license_scan, media, mixing, periodic_runs, pii, prefix_trie, secret_scan, simhash, sql, suffix_dedup, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(_table(spark, sf_dir, "documents"))


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.document_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema)
    every = rows.union(more)
    return chat.digests(chat.format_chats(every.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the benchmark items found in them."""
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, about a tenth of which are made periodic from some word on."""
    return periodic_runs.digests(periodic_runs.find(periodic_runs.with_repeats(_table(spark, sf_dir, "documents"))))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that those of a hundred share beginnings."""
    return prefix_trie.of_rebuilt(_table(spark, sf_dir, "conversations"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find(_table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = (
        op1_pii, op2_toxicity, op3_suffix_dedup, op4_media, op5_license, op6_mixing, op7_warc, op8_simhash, op9_chat, op10_decontamination,
        op11_periodic_runs, op12_prefix_trie, op13_secrets, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op1_pii": sql.PII, "op5_license": sql.LICENSE, "op6_mixing": sql.MIX, "op7_warc": sql.WARC, "op9_chat": sql.CHATS, "op12_prefix_trie": sql.TRIE}
