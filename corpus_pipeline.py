"""Documents to token ids in five stages, each written as Parquet and read by the next.

ORACLE_SQL is None: a fitted classifier, near copies and BPE merges can't be stated in SQL.
tests/llm holds each stage against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import bpe, chosen_path, decontaminate, line_dedup, toxicity
from notewright.llm.common import prepare, table
from notewright.session import materialize

TOXIC = toxicity.FtrlParams().threshold


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below TOXIC; the model learns from the labelled rows of ``docs``."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"), TOXIC)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that five documents share but in the last of them."""
    kept = line_dedup.drop_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_copy_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each class of near copies."""
    return chosen_path.keep_first(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the bytes that they decode to."""
    return bpe.encode_checked(docs, public_tokenizers.path(bpe.RANKS), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_filter),
    ("near_copies", near_copy_filter),
    ("decontaminate", benchmark_filter),
    ("encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
