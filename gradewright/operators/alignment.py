"""Page alignment from anchor rows: tier choice, transform matrix, box mapping."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.functions.geometry import CORNERS, complete_corners, scale_matrix, transform_box
from gradewright.functions.numeric import round_half_up


def corner_columns(anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anchor rows (keys, corner, x, y) as one row per page with a point per corner."""
    point = F.struct("x", "y")
    return anchors.groupBy(*keys).agg(
        *[F.first(F.when(F.col("corner") == c, point), ignorenulls=True).alias(c) for c in CORNERS]
    )


def choose_tier(found: DataFrame) -> DataFrame:
    """Adds n_found, mode, and the corners with one missing one estimated.

    Four corners, or three and an estimate, give a perspective transform; fewer
    leave plain scaling.
    """
    n = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in CORNERS), F.lit(0))
    filled = complete_corners({c: F.col(c) for c in CORNERS})
    counted = found.withColumn("n_found", n)
    done = counted.select(
        *[c for c in counted.columns if c not in CORNERS],
        *[F.when(F.col("n_found") >= 3, filled[c]).otherwise(F.col(c)).alias(c) for c in CORNERS],
    )
    complete = F.lit(True)
    for c in CORNERS:
        complete = complete & F.col(c).isNotNull()
    return done.withColumn("mode", F.when(complete, "homography").otherwise("scale"))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Perspective matrices for a batch of pages, solved as one stacked system."""
    for pdf in batches:
        out: list[list[float] | None] = [None] * len(pdf)
        rows = [i for i, v in enumerate(pdf["src"]) if v is not None]
        if rows:
            src = np.array([list(pdf["src"].iloc[i]) for i in rows], dtype=float).reshape(-1, 4, 2)
            dst = np.array([list(pdf["dst"].iloc[i]) for i in rows], dtype=float).reshape(-1, 4, 2)
            m = len(rows)
            a = np.zeros((m, 8, 8))
            x, y, u, v = src[:, :, 0], src[:, :, 1], dst[:, :, 0], dst[:, :, 1]
            a[:, 0::2, 0], a[:, 0::2, 1], a[:, 0::2, 2] = x, y, 1
            a[:, 1::2, 3], a[:, 1::2, 4], a[:, 1::2, 5] = x, y, 1
            a[:, 0::2, 6], a[:, 0::2, 7] = -x * u, -y * u
            a[:, 1::2, 6], a[:, 1::2, 7] = -x * v, -y * v
            b = np.stack([u, v], axis=2).reshape(m, 8, 1)
            regular = np.abs(np.linalg.det(a)) > 1e-9
            if regular.any():
                h = np.linalg.solve(a[regular], b[regular])[:, :, 0]
                for i, vec in zip(np.array(rows)[regular], h):
                    out[i] = [*map(float, vec), 1.0]
        yield pdf.drop(columns=["src", "dst"]).assign(matrix=pd.Series(out, index=pdf.index, dtype=object))


def page_transforms(tiers: DataFrame, references: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, mode, n_found, matrix: nine numbers taking map points to scan pixels.

    ``references`` has keys, the corner points of the map, page_width,
    page_height, scan_width, scan_height. A degenerate corner set falls back to
    scaling.
    """
    keys = list(keys)
    ref = references.select(
        *keys,
        *[F.col(c).alias(f"r_{c}") for c in CORNERS],
        (F.col("scan_width") / F.col("page_width")).alias("scale_x"),
        (F.col("scan_height") / F.col("page_height")).alias("scale_y"),
    )
    pages = ref.join(tiers, keys, "left")

    def flat(prefix: str):
        parts = [F.col(f"{prefix}{c}")[axis].cast("double") for c in CORNERS for axis in ("x", "y")]
        return F.array(*parts)

    usable = F.coalesce(F.col("mode") == "homography", F.lit(False))
    ready = pages.select(
        *keys,
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
        "scale_x",
        "scale_y",
        F.when(usable, flat("r_")).alias("src"),
        F.when(usable, flat("")).alias("dst"),
    )
    schema = ready.drop("src", "dst").schema.add("matrix", T.ArrayType(T.DoubleType()))
    solved = ready.mapInPandas(_solve, schema)
    fits = F.col("matrix").isNotNull()
    return solved.select(
        *keys,
        "n_found",
        F.when(fits, "homography").otherwise("scale").alias("mode"),
        "scale_x",
        "scale_y",
        F.lit(0.0).alias("offset_x"),
        F.lit(0.0).alias("offset_y"),
        F.when(fits, F.col("matrix")).otherwise(scale_matrix(F.col("scale_x"), F.col("scale_y"))).alias("matrix"),
    )


def map_boxes(boxes: DataFrame, transforms: DataFrame, keys: Sequence[str], box: str = "box") -> DataFrame:
    """Boxes of a page in scan pixels."""
    return boxes.join(transforms.select(*keys, "matrix"), list(keys)).withColumn(
        "scan_box", transform_box("matrix", box)
    ).drop("matrix")


def transform_report(transforms: DataFrame, keys: Sequence[str]) -> DataFrame:
    return transforms.select(
        *keys,
        F.col("mode").alias("transform_mode"),
        F.col("n_found").alias("anchors_detected"),
        round_half_up("scale_x", 4).alias("scale_x"),
        round_half_up("scale_y", 4).alias("scale_y"),
        round_half_up("offset_x", 2).alias("offset_x"),
        round_half_up("offset_y", 2).alias("offset_y"),
    )
