"""Islands on a series: runs above a level, merged over small gaps, padded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.operators.running import segments


def islands(
    series: DataFrame,
    position: str,
    value: str,
    level,
    by: Sequence[str] = (),
    min_length: int = 10,
    merge_gap: int = 8,
    pad: int = 6,
    height=None,
    bits: int = 16,
) -> DataFrame:
    """(by.., start, end) with end exclusive; missing positions count as low."""
    by = list(by)
    level = level if not isinstance(level, (int, float)) else F.lit(level)
    high = series.where(F.col(value) >= level).select(*by, F.col(position).cast("bigint").alias("_y"))
    runs = (
        segments(high, "_y", F.col("_y"), F.col("_y"), lambda before, here: before.isNull() | (here - before > 1), "_run", by, bits)
        .groupBy(*by, "_run")
        .agg(F.min("_y").alias("_s"), (F.max("_y") + 1).alias("_e"))
        .where(F.col("_e") - F.col("_s") >= min_length)
        .select(*by, "_s", "_e")
    )
    end = F.max("_e") + pad
    if height is not None:
        end = F.least(end, height if not isinstance(height, int) else F.lit(height))
    return (
        segments(runs, "_s", F.col("_e"), F.col("_s"), lambda before, here: before.isNull() | (here - before >= merge_gap), "_band", by, bits)
        .groupBy(*by, "_band")
        .agg(F.greatest(F.min("_s") - pad, F.lit(0)).alias("start"), end.alias("end"))
        .drop("_band")
    )
