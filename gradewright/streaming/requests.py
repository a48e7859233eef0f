"""Reuse of identical requests for a limited time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gradewright.settings import DEFAULTS, Thresholds


def dedupe_stream(requests: DataFrame, ts: str = "ts", key: str = "fingerprint", cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Streaming form: drops repeats within the watermark. It expires with the
    watermark, not exactly ``ttl`` after the first request."""
    delay = f"{cfg.request_ttl_seconds} seconds"
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
