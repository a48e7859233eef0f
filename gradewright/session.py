"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_own: list[tempfile.TemporaryDirectory] = []


def local_session(app: str = "gradewright", cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and the benchmark. On a cluster the job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GRADEWRIGHT_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors reach, as the cluster names it in ``spark.checkpoint.dir``. Only where it is unset and everything
    runs in this process, a temporary folder takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors reach")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="gradewright-"))
        root = f"file://{_own[0].name}"
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name all executors reach, for stream checkpoints."""
    return f"{shared_root(spark)}/gradewright/{name}"


def keep(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, its lineage ends, and it survives lost executors.
    ``by`` names columns of few values whose rows are read apart."""
    path = shared_folder(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


TASK_ROWS = 250_000  # rows that a task holds and sorts at a time


def dealt(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Deal about ``rows`` rows out by key, to tasks of ``TASK_ROWS`` rows: Spark merges shuffled parts by their packed bytes, of which a
    sort takes many times the memory. Few rows are left to it."""
    spark = df.sparkSession
    tasks = -(-rows // TASK_ROWS)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    # joins keep a side that has the session's number of parts or more
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. How it is split is up to the session's configuration."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
