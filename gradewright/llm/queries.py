"""The registered queries of the text operators: each applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.llm import chat_format, decontaminate, language_id, line_dedup, mixing, near_dedup, quality, secrets, sharding, source_audit, toxicity
from gradewright.llm import turn_repair, url_filter

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark, sf_dir):
    """Every line's class, the number of classes it is linked to, and whether the line stays."""
    return line_dedup.judge(table(spark, sf_dir, "documents"), n_links=True)


@query
def op2_mix_sources(spark, sf_dir):
    """The words that a mix of all documents takes of each."""
    return mixing.report(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    """A toxicity score of every document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_url_filter(spark, sf_dir):
    """Rule and verdict of every page."""
    return url_filter.report(table(spark, sf_dir, "pages"))


@query
def op5_chat_format(spark, sf_dir):
    """All conversations formatted, and one that says control strings, read back from the output."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat_format.report(rows.unionByName(tricky))


@query
def op6_hash_tree_shards(spark, sf_dir):
    """Every document's shard of 24, its slot there, and its shard when there is one more."""
    return sharding.digest(table(spark, sf_dir, "documents"))


@query
def op7_minhash_dedup(spark, sf_dir):
    """The near-duplicate component of every document."""
    return near_dedup.report(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark, sf_dir):
    """Statistics, base verdict and robust outlier verdict of every document."""
    return quality.report(table(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark, sf_dir):
    """Benchmark windows found in every document."""
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op11_source_audit(spark, sf_dir):
    """Divergences of the sources of every language, in pairs and by term."""
    return source_audit.report(table(spark, sf_dir, "documents"))


@query
def op12_turn_repair(spark, sf_dir):
    """Faults, cheapest repair and repaired text of every conversation, damaged first."""
    return turn_repair.report(table(spark, sf_dir, "conversations"))


@query
def op13_language_id(spark, sf_dir):
    """The language of every document."""
    return language_id.report(table(spark, sf_dir, "documents"))
