"""Rubric verdicts: an ordered rule list compiled into one column expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import record
from gradewright.functions.numeric import col_of, safe_double
from gradewright.functions.text import mentions_safety_phrase
from gradewright.settings import DEFAULTS, Thresholds


class Rule:
    """One rule. Subclass it and override what it changes; no Python runs per row."""

    def score(self, verdict: Column, score: Column, maximum: Column) -> Column:
        return score

    def fatal(self, verdict: Column) -> Column:
        return F.lit(False)

    def review(self, verdict: Column) -> Column:
        return F.lit(False)


def _set(verdict: Column, field: str) -> Column:
    return F.coalesce(verdict[field], F.lit(False))


@dataclass(frozen=True)
class RatingRule(Rule):
    """Rating 1..5 to 0..100 % of the points; missing counts as 1, unreadable adds nothing.

    ``present`` names a boolean field telling a missing rating from a null one;
    without it null counts as missing, which scores the same.
    """

    field: str = "semantic_relevance_rating"

    def score(self, verdict, score, maximum):
        raw = verdict[self.field].cast("string")
        rating = F.when(raw.isNull(), F.lit(1.0)).otherwise(raw.try_cast("double"))
        return F.coalesce(score + (rating - 1) / 4 * maximum, score)


@dataclass(frozen=True)
class DeductiveRule(Rule):
    field: str = "missed_key_concepts"
    share: float = 0.25

    def score(self, verdict, score, maximum):
        return F.when(_set(verdict, self.field), score - maximum * self.share).otherwise(score)


@dataclass(frozen=True)
class ReviewRule(Rule):
    field: str = "hallucination_detected"

    def review(self, verdict):
        return _set(verdict, self.field)


@dataclass(frozen=True)
class FatalRule(Rule):
    field: str = "cheating_detected"
    flags_review: bool = True

    def fatal(self, verdict):
        return _set(verdict, self.field)

    def review(self, verdict):
        return F.lit(self.flags_review)


STANDARD_RULES: tuple[Rule, ...] = (RatingRule(), DeductiveRule(), ReviewRule(), FatalRule())


def evaluate(verdict, maximum, rules: Sequence[Rule] = STANDARD_RULES, base: float = 0.0) -> Column:
    """struct(score, fatal, review) of a verdict under the rules, in order.

    A fatal rule ends the evaluation: score 0, its own review setting, and no
    clamping; rules after it are not looked at.
    """
    v, top = col_of(verdict), safe_double(maximum)
    score: Column = F.lit(float(base))
    fatal: Column = F.lit(False)
    review: Column = F.lit(False)
    for rule in rules:
        if isinstance(rule, FatalRule):
            now = ~fatal & rule.fatal(v)
            review = F.when(now, rule.review(v)).otherwise(review)
            score = F.when(now, F.lit(0.0)).otherwise(score)
            fatal = fatal | now
        else:
            review = review | (~fatal & rule.review(v))
            score = F.when(fatal, score).otherwise(rule.score(v, score, top))
    bounded = F.greatest(F.lit(0.0), F.least(score, top))
    return record(score=F.when(fatal, score).otherwise(bounded), fatal=fatal, review=review)


def apply_rubric(
    df: DataFrame, verdict: str = "verdict", maximum: str = "max_points", rules: Sequence[Rule] = STANDARD_RULES
) -> DataFrame:
    """Adds rubric_score, is_fatal, requires_review."""
    return (
        df.withColumn("_r", evaluate(verdict, maximum, rules))
        .withColumns(
            {
                "rubric_score": F.col("_r.score"),
                "is_fatal": F.col("_r.fatal"),
                "requires_review": F.col("_r.review"),
            }
        )
        .drop("_r")
    )


def post_process(
    df: DataFrame,
    explanation: str = "explanation",
    failed: str | None = None,
    crashed: str | None = None,
    student_text: str | None = None,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Turn rubric outcomes into result rows.

    ``failed`` marks verdicts the grader answered with an error (ai_error);
    ``crashed`` holds an error text, maybe empty, when no verdict came back at all.
    With grading switched off every row waits for a teacher. The messages are fixed
    values; texts in them are whole.
    """
    text = F.coalesce(F.col(explanation), F.lit(""))
    failed_c = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    crashed_c = F.col(crashed) if crashed else F.lit(None).cast("string")
    is_crash = crashed_c.isNotNull()
    wrote = F.col(student_text) if student_text else F.lit(None).cast("string")
    quoted = F.when(
        F.coalesce(wrote, F.lit("")) != "",
        F.concat(F.lit(' Student wrote: "'), wrote, F.lit('"')),
    ).otherwise(F.lit(""))
    dropped = [c for c in (explanation,) if c in df.columns]
    if not cfg.ai_enabled:
        waiting = F.when(quoted != "", F.concat(F.lit("Open-ended — awaiting manual review."), quoted)).otherwise(
            F.lit("Open-ended — awaiting manual review. (Could not OCR student text.)")
        )
        return df.drop(*dropped).withColumns(
            {
                "score": F.lit(0.0),
                "confidence": F.lit(0.0),
                "status": F.lit("pending_review"),
                "needs_review": F.lit(True),
                "explanation": waiting,
            }
        )
    review = F.col("requires_review") | F.col("is_fatal")
    flagged = mentions_safety_phrase(text)
    confidence = (
        F.when(is_crash | failed_c, F.lit(0.0)).when(review, F.lit(0.50)).otherwise(F.lit(0.95))
    )
    out = {
        "score": F.when(is_crash | failed_c, F.lit(0.0)).otherwise(F.col("rubric_score")),
        "confidence": confidence,
        "status": F.when(is_crash, "pending_review")
        .when(flagged, "ai_flagged")
        .when(failed_c, "ai_error")
        .otherwise("ai_graded"),
        "needs_review": is_crash | failed_c | flagged | review | (confidence < cfg.high_confidence),
        "explanation": F.when(
            is_crash,
            F.concat(
                F.when(crashed_c == "", F.lit("AI unavailable")).otherwise(F.concat(F.lit("AI error ("), crashed_c, F.lit(")"))),
                F.lit(" — awaiting manual review."),
                quoted,
            ),
        )
        .when(failed_c & F.col(explanation).isNull(), F.lit("Unknown AI error"))
        .otherwise(text),
    }
    return df.withColumns(out)


def grader_reply(df: DataFrame, justification: str = "justification") -> DataFrame:
    """Single-answer grading: an echoed phrase forces review and the flag status."""
    hit = mentions_safety_phrase(justification)
    return df.withColumns(
        {
            "requires_review": F.coalesce(F.col("requires_review"), F.lit(False)) | hit,
            "status": F.when(hit, F.lit("ai_flagged")).otherwise(F.col("status")),
        }
    )
