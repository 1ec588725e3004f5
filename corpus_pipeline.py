"""The corpus pipeline: five operators over documents, each on what the one before kept.

What null, empty and long texts, repeated rows, ties and empty tables give in a stage is said at the function that
it calls; the first four keep all columns, also others than those of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import byte_bpe, decontaminate, line_dedup, quality, simhash_dedup
from tidelog.scratch import scratch_path


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that lost lines."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and with them the lines that too many documents of a host repeat."""
    return _sized(quality.keep_good(docs))


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal and nearly equal lines, one occurrence stays; documents stay, if need be empty."""
    return _sized(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", fuzzy_lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]
#: SQL has no byte-level BPE, edit similarity over blocks or connected groups; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k:
            path = scratch_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
