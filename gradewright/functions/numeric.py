"""Numbers: safe casts, one rounding rule, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright.settings import DEFAULTS, Thresholds


def col_of(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def safe_double(value, default: float = 0.0) -> Column:
    """Cast to double; null or unreadable text becomes ``default``."""
    return F.coalesce(col_of(value).try_cast("double"), F.lit(float(default)))


def round_half_up(value, digits: int) -> Column:
    """The one rounding rule: half up on a decimal copy of the double.

    Two decimals of a score need six spare digits at most; confidences and
    similarities are rounded to four places and keep ten.
    """
    scale = 6 if digits <= 2 else 10
    return F.round(col_of(value).cast(f"decimal(18,{scale})"), digits).cast("double")


def round_score(value) -> Column:
    return round_half_up(value, 2)


def percent(total, maximum, digits: int | None = 1) -> Column:
    """total / maximum * 100, 0 when there is nothing to earn."""
    total, maximum = col_of(total), col_of(maximum)
    share = total / F.nullif(maximum, F.lit(0.0)) * 100
    value = round_half_up(share, digits) if digits is not None else share
    return F.when(maximum > 0, value).otherwise(F.lit(0.0))


def percent_of_at_least_one(total, maximum) -> Column:
    """The accuracy report's variant: a maximum of 0 (or null) counts as 1."""
    maximum = F.coalesce(F.nullif(col_of(maximum), F.lit(0.0)), F.lit(1.0))
    return F.coalesce(col_of(total), F.lit(0.0)) / maximum * 100


def rate(part, whole, digits: int = 1) -> Column:
    """part / whole as a rounded percentage, 0 for an empty whole."""
    part, whole = col_of(part), col_of(whole)
    return F.when(whole > 0, round_half_up(part / F.nullif(whole, F.lit(0)) * 100, digits)).otherwise(
        F.lit(0.0)
    )


def clamp(value, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(low, F.least(col_of(value), high))


def confidence_percent(confidence) -> Column:
    return round_half_up(F.coalesce(col_of(confidence), F.lit(0.0)) * 100, 1)


def confidence_is_low(confidence, cfg: Thresholds = DEFAULTS) -> Column:
    return F.coalesce(col_of(confidence), F.lit(0.0)) < F.lit(cfg.high_confidence)


def hash_bucket(key, buckets: int = 100) -> Column:
    """Stable bucket of a text key: first 32 bits of its md5, modulo ``buckets``."""
    head = F.substring(F.md5(col_of(key).cast("string")), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % F.lit(buckets)).cast("int")
