"""Was a question answered correctly, for the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright.functions.numeric import col_of, safe_double
from gradewright.settings import DEFAULTS, REVIEW_STATUSES, Thresholds


def judged_correct(status, q_type, score, max_points, has_is_correct=None, is_correct=None) -> Column:
    """The reader's own verdict when the record carries the field (also as null),
    else the status, else half the points of an open question."""
    s = F.coalesce(col_of(status), F.lit(""))
    top = F.coalesce(F.nullif(safe_double(max_points), F.lit(0.0)), F.lit(1.0))
    by_status = (
        F.when(s == "correct", True)
        .when(s.isin("wrong", "blank", "error", "partial"), False)
        .when(col_of(q_type) == "open_ended", safe_double(score) >= top * 0.5)
        .otherwise(False)
    )
    if has_is_correct is None:
        return by_status
    own = F.coalesce(col_of(is_correct), F.lit(False))
    return F.when(F.coalesce(col_of(has_is_correct), F.lit(False)), own).otherwise(by_status)


def judged_partial(status) -> Column:
    return F.coalesce(col_of(status) == "partial", F.lit(False))


def is_correct(status) -> Column:
    return F.coalesce(col_of(status) == "correct", F.lit(False))


# Three different review rules; they disagree on purpose and are never merged.


def review_in_store(flag, status) -> Column:
    """Store: an explicit flag or one of three statuses."""
    return F.coalesce(col_of(flag), F.lit(False)) | F.coalesce(col_of(status).isin(*REVIEW_STATUSES), F.lit(False))


def review_on_sheet(flag, confidence, cfg: Thresholds = DEFAULTS) -> Column:
    """Score sheet: flag or low confidence; a missing question has confidence 0."""
    return F.coalesce(col_of(flag), F.lit(False)) | (F.coalesce(col_of(confidence), F.lit(0.0)) < cfg.high_confidence)


def review_in_summary(flag, confidence, cfg: Thresholds = DEFAULTS) -> Column:
    """Summary: only present questions count; a missing confidence is 1."""
    return F.coalesce(col_of(flag), F.lit(False)) | (F.coalesce(col_of(confidence), F.lit(1.0)) < cfg.high_confidence)


def recovered_status(q_type, score, max_points) -> Column:
    s, m = col_of(score), col_of(max_points)
    graded = F.when(s > 0, "graded").otherwise("wrong")
    other = F.when(s >= m, "correct").when(s == 0, "wrong").otherwise("partial")
    return F.when(col_of(q_type) == "open_ended", graded).otherwise(other)


def recovered_review(q_type, confidence, sheet_review, cfg: Thresholds = DEFAULTS) -> Column:
    return F.when(
        col_of(q_type) == "open_ended", F.coalesce(col_of(sheet_review) == "YES", F.lit(False))
    ).otherwise(col_of(confidence) < cfg.high_confidence)
