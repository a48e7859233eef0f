"""Helpers that the text operators share: words, seeded draws, tables kept between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.session import shared_root

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"
BATCH_ROWS = 500


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def pieces(text: Column, breaks: str) -> Column:
    """The non-empty pieces of a text between matches of ``breaks``; no text has none."""
    return F.coalesce(F.array_remove(F.split(text, breaks), ""), F.array().cast("array<string>"))


def uniform(*parts) -> Column:
    """A draw in (0, 1) from the MD5 of the parts joined by a colon. SQL can restate it, unlike
    Spark's own hashes. A null part counts as the word null."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs inside, so that a Python worker holds few texts at a time."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back. It cuts the lineage and survives lost
    executors; a result that is used twice is computed once."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/gradewright/{name}-{uuid.uuid4().hex}"
    with short_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_alone(df: DataFrame, name: str) -> DataFrame:
    """``keep``, and what the job shuffled goes when its table is written."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return keep(df, name)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast a side whose counted ``rows`` are within ``limit``. Beyond it the side is left alone and
    Spark joins by a shuffle, splitting skewed partitions."""
    return F.broadcast(df) if rows <= limit else df
