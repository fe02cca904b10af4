"""The corpus pipeline: documents through quality rules, near-duplicate and repeat removal, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_pieces, decontamination, metric_join, quality_rules, run_index
from quillspark.llm.common import delete, fresh_path, scope, table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.filter_documents(docs, "v1")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates: five-word shingles, similarity 0.8."""
    return metric_join.keep_one(docs, k=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a document with a smaller id also has; n_chars follows the text."""
    out = run_index.strip_repeats(docs, run_index.LENGTH)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe_pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", rules), ("jaccard_join", near_duplicates), ("suffix_dedup", repeats), ("decontamination", benchmark), ("piece_encoding", encoded)]

#: The stages are not expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and reread; what no later stage reads is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scope(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
