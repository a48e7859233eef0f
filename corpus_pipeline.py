"""The corpus pipeline: each stage's table is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradewright.llm import decontaminate, mixing, near_dedup, quality, sharding
from gradewright.llm.common import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are robust outliers go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dedup.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard of 24, its slot there, and its shard when there is one more."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("mix", source_mix),
    ("shard", shards),
]

ORACLE_SQL = None  # robust estimates and MinHash have no SQL form; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Stage tables are in the shared folder, so that lost executors repeat one
    stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
