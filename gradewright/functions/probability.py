"""Confidences from model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright.functions.collections import bind, record
from gradewright.functions.numeric import col_of, round_half_up
from gradewright.settings import DEFAULTS, Thresholds


def token_confidence(probabilities, cfg: Thresholds = DEFAULTS) -> Column:
    """Mean token probability, cut when the weakest token is weak, then calibrated."""
    p = F.coalesce(col_of(probabilities), F.array().cast("array<double>"))
    n = F.size(p)
    mean = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(n, F.lit(0))
    weakest = F.array_min(p)
    factor = (
        F.when(weakest < cfg.token_bad, F.lit(0.5)).when(weakest < cfg.token_warn, F.lit(0.7)).otherwise(1.0)
    )
    base = F.when(n > 0, mean * factor).otherwise(F.lit(0.5))
    return round_half_up(F.least(base * cfg.token_calibration, F.lit(1.0)), 4)


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def restricted_argmax(logits, allowed=None) -> Column:
    """Letter and raw probability: the best class overall when it is allowed (or
    nothing is restricted), else the best allowed class with its own unscaled
    probability. First class wins ties.

    Classes are compared by their logits, which order them like the softmax; the
    softmax itself is needed for the chosen class only.
    """
    ranked = F.transform(
        col_of(logits).cast("array<double>"),
        lambda x, i: record(x=x, neg=-i, letter=F.substr(F.lit(LETTERS), i + 1, F.lit(1))),
    )

    def pick(classes: Column) -> Column:
        top = F.array_max(classes)
        if allowed is None:
            best = top
        else:
            legal = F.array_distinct(
                F.transform(F.filter(col_of(allowed), lambda a: a.rlike("^[A-Za-z]$")), lambda a: F.upper(a))
            )
            free = F.coalesce(F.size(legal), F.lit(0)) == 0
            inside = F.array_max(F.filter(classes, lambda c: F.array_contains(legal, c["letter"])))
            best = F.when(free, top).otherwise(F.coalesce(inside, top))
        return record(classes=classes, top=top["x"], best=best)

    def outcome(chosen: Column) -> Column:
        total = F.aggregate(
            chosen["classes"], F.lit(0.0), lambda acc, c: acc + F.exp(c["x"] - chosen["top"])
        )
        p = F.exp(chosen["best"]["x"] - chosen["top"]) / total
        return record(letter=chosen["best"]["letter"], confidence=round_half_up(p, 4))

    return bind(bind(ranked, pick), outcome)
