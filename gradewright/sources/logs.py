"""Stage logs as files, read once or followed as a stream.

A log may be cut into numbered pieces (``run.log.1``, ``run.log.2``): the number is taken off its name, and all pieces are one source.
A text file has no line numbers, and Spark splits it. Inside one split (a file and its first byte) the lines are read in order, so a line
is placed by the piece, the split, and its number there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewright.functions.text import STAGE_TAG

ROTATED = r"\.(\d+)$"  # what follows a log's name in the names of its pieces


def log_name(path: Column, rotated: str = ROTATED) -> Column:
    return F.regexp_replace(path, rotated, "")


def log_piece(path: Column, rotated: str = ROTATED) -> Column:
    """Number of a piece; 0 for a log that is one file."""
    return F.coalesce(F.regexp_extract(path, rotated, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def read_stage_log(spark: SparkSession, path: str, rotated: str = ROTATED) -> DataFrame:
    """Stage lines (source, line_no, line) of log files; line numbers run over all pieces of a log.

    The numbers come from the sizes of the splits before, so the files are read twice, split alike.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        log_name(F.col("_metadata.file_path"), rotated).alias("source"),
        log_piece(F.col("_metadata.file_path"), rotated).alias("_piece"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    # inside one split ids grow by one; splits of a log are ordered by piece and start
    first = lines.groupBy("source", "_piece", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("_piece", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = lines.join(offsets.drop("_n"), ["source", "_piece", "_block"]).select(
        "source", (F.col("_before") + F.col("_id") - F.col("_first")).cast("bigint").alias("line_no"), "line"
    )
    return numbered.where(F.contains("line", F.lit(STAGE_TAG)))


PLACED = "line string, path string, block bigint, ingest_ts timestamp, seq bigint, block_lines bigint"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stage lines (line, path, block, ingest_ts) with their number in the split, and a row without a line
    behind each split that tells how many lines it had."""
    key, seen, last_ts = None, 0, None

    def trailer() -> pa.RecordBatch:
        values = [pa.array([None], pa.string()), pa.array([key[0]]), pa.array([key[1]], pa.int64()), last_ts]
        return pa.RecordBatch.from_arrays([*values, pa.array([None], pa.int64()), pa.array([seen], pa.int64())], names)

    names = ["line", "path", "block", "ingest_ts", "seq", "block_lines"]
    for batch in batches:
        paths, blocks = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(paths):
            if key != (paths[start], int(blocks[start])):
                if key is not None:
                    yield trailer()
                key, seen = (paths[start], int(blocks[start])), 0
            end = start + 1
            while end < len(paths) and (paths[end], int(blocks[end])) == key:
                end += 1
            part = batch.slice(start, end - start)
            seq = pa.array(np.arange(seen, seen + end - start))
            nulls = pa.nulls(end - start, pa.int64())
            lines = pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), seq, nulls], names)
            yield lines.filter(pc.match_substring(part.column(0), STAGE_TAG))
            last_ts = part.column(3).slice(0, 1)
            seen, start = seen + end - start, end
    if key is not None:
        yield trailer()


def stream_stage_log(spark: SparkSession, path: str, max_files: int | None = None, rotated: str = ROTATED, max_bytes: int = 256 << 20) -> DataFrame:
    """Follow the log files of a folder: new files, at most ``max_files`` a trigger, oldest first. Without a number of files a trigger takes
    ``max_bytes`` of them: a trigger costs the same for few lines as for many, so many small logs are not followed a few at a time.

    Gives the stage lines with ``source``, ``ingest_ts`` and their place (``piece``, ``block``, ``seq``), and behind every split a
    row without a line whose ``block_lines`` counts its lines; ``batch_state`` numbers lines by them.
    """
    limit = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    lines = spark.readStream.format("text").option(*limit).load(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").cast("bigint").alias("block"),
        F.current_timestamp().alias("ingest_ts"),
    )
    placed = lines.mapInArrow(_placed, PLACED)
    source, piece = log_name(F.col("path"), rotated).alias("source"), log_piece(F.col("path"), rotated).alias("piece")
    return placed.select(source, piece, "block", "seq", "block_lines", "ingest_ts", "line")
