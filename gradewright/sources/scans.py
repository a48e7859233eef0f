"""Page scans: image rows, and the dark share of boxes on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.settings import DEFAULTS, Thresholds

# file names end in the page number: <batch>_<page>.<type> or <batch>/<page>.<type>
NAME = r"([^/]+?)[_/](\d+)\.[A-Za-z]+$"


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Rasterised pages: batch, page index, and the image as rows of BGR bytes."""
    images = spark.read.format("image").load(path)
    return images.select(
        F.regexp_extract("image.origin", NAME, 1).alias("batch_name"),
        F.regexp_extract("image.origin", NAME, 2).try_cast("int").alias("page_idx"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def _grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, dtype=np.uint8)[: height * width * channels].reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    # fixed values: the usual luma weights, on blue, green, red
    luma = pixels[:, :, :3].astype(np.float32) @ np.array([0.114, 0.587, 0.299], dtype=np.float32)
    return np.rint(luma).astype(np.uint8)


def _window(box, height: int, width: int, inset: int) -> tuple[int, int, int, int]:
    """Whole-pixel part of a box inside the page; without inset on tiny boxes."""
    x, y, w, h = (int(round(box[k] or 0)) for k in ("x", "y", "w", "h"))
    if w > 2 * inset and h > 2 * inset:
        x, y, w, h = x + inset, y + inset, w - 2 * inset, h - 2 * inset
    x, y = max(0, min(x, width - 1)), max(0, min(y, height - 1))
    return x, y, min(w, width - x), min(h, height - y)


def dark_shares(pages: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Measure boxes on page images.

    ``pages`` has one row per page: height, width, channels, data and ``boxes``,
    an array of struct(key, x, y, w, h); further columns pass through. A page
    travels to Python once with all its boxes, which are as many as its map has.
    Adds key, ratio (inside the printed border) and is_blank (whole box).
    """
    passed = [c for c in pages.columns if c not in ("height", "width", "channels", "data", "boxes")]
    inset, dark_at, blank_at = cfg.mark_inset, cfg.dark_level, cfg.blank_dark_share

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in (*passed, "key", "ratio", "is_blank")}
            for row in pdf.itertuples(index=False):
                dark = _grey(row.data, row.height, row.width, row.channels) <= dark_at
                for box in row.boxes:
                    x, y, w, h = _window(box, row.height, row.width, inset)
                    ratio = float(dark[y : y + h, x : x + w].mean()) if w > 0 and h > 0 else 0.0
                    x, y, w, h = _window(box, row.height, row.width, 0)
                    whole = float(dark[y : y + h, x : x + w].mean()) if w > 0 and h > 0 else 0.0
                    for c in passed:
                        out[c].append(getattr(row, c))
                    out["key"].append(box["key"])
                    out["ratio"].append(ratio)
                    out["is_blank"].append(whole < blank_at)
            yield pd.DataFrame(out)

    schema = pages.select(*passed).schema.add("key", "string").add("ratio", "double").add("is_blank", "boolean")
    return pages.mapInPandas(measure, schema)


def read_cells(pages: DataFrame, reader, schema: str):
    """Run a reader over page rows. ``reader`` maps a pandas frame of page rows to
    one of (cell keys, reader, text, confidence); it may load its model once per
    worker, for it is called batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield reader(pdf)

    return pages.mapInPandas(run, schema)
