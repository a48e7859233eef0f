"""Student numbers: three digit readers reconciled position by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import record
from gradewright.functions.numeric import round_half_up
from gradewright.settings import CONFUSABLE_DIGITS, DEFAULTS, Thresholds


def _digits(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def _is_confusable(c: Column) -> Column:
    return c.isin(*CONFUSABLE_DIGITS)


def reconcile_numbers(
    df: DataFrame,
    boxes: str = "cnn_text",
    box_confs: str = "cnn_confs",
    strip: str = "strip_text",
    strip_conf: str = "strip_conf",
    third: str = "third_text",
    third_conf: str = "third_conf",
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Adds number, confidence, source, needs_review and the counts.

    The per-box reader is checked against the strip reader when both found the
    same number of digits; the third reader is heard only when one of the digits
    is easily confused, and only at the right length. All per row, no shuffle.
    """
    cd, td, vd = _digits(F.col(boxes)), _digits(F.col(strip)), _digits(F.col(third))
    df = df.withColumns({"_c": cd, "_t": td, "_v": vd})
    n = F.size("_c")
    strip_used = (F.size("_t") > 0) & (F.size("_t") == n)
    doubtful = F.exists(F.concat("_c", "_t"), _is_confusable)
    third_used = strip_used & doubtful & (F.size("_v") == n)
    df = df.withColumns({"_strip": strip_used, "_third": third_used})
    tc = F.coalesce(F.col(strip_conf), F.lit(0.0))
    vc = F.coalesce(F.col(third_conf), F.lit(0.0))

    def decide(c: Column, i: Column) -> Column:
        conf = F.get(F.col(box_confs), i)
        t, v = F.get(F.col("_t"), i), F.get(F.col("_v"), i)
        heard = F.col("_third") & v.rlike("^[0-9]$")

        def out(digit, confidence, agree=0, disagree=0, override=0):
            return record(
                digit=digit,
                conf=confidence,
                agree=F.lit(agree),
                disagree=F.lit(disagree),
                override=F.lit(override),
            )

        both = c == t
        swapped = both & heard & (v != c) & _is_confusable(c)
        strip_better = (
            (c == "?") | (conf < tc - 0.05) | (_is_confusable(c) & _is_confusable(t))
        )
        return (
            F.when(~F.col("_strip"), out(c, conf))
            .when(swapped, out(v, vc, disagree=1, override=1))
            .when(both, out(c, F.least(F.lit(1.0), F.greatest(conf, tc) * 1.05), agree=1))
            .when(heard & (v == c), out(c, F.greatest(conf, vc), disagree=1))
            .when(heard & (v == t), out(t, F.greatest(tc, vc), disagree=1, override=1))
            .when(heard, out(v, vc, disagree=1, override=1))
            .when(strip_better, out(t, tc, disagree=1, override=1))
            .otherwise(out(c, conf * 0.85, disagree=1))
        )

    df = df.withColumn("_d", F.transform("_c", decide))

    def total(field: str) -> Column:
        return F.aggregate("_d", F.lit(0), lambda acc, x: acc + x[field])

    conf_sum = F.aggregate("_d", F.lit(0.0), lambda acc, x: acc + x["conf"])
    df = df.withColumns(
        {
            "number": F.array_join(F.transform("_d", lambda x: x["digit"]), ""),
            "confidence": F.coalesce(round_half_up(conf_sum / F.nullif(n, F.lit(0)), 4), F.lit(0.0)),
            "agreements": total("agree"),
            "disagreements": total("disagree"),
            "overrides": total("override"),
        }
    )
    return df.withColumns(
        {
            "needs_review": (F.col("confidence") < cfg.high_confidence)
            | F.contains("number", F.lit("?"))
            | (F.col("_strip") & (F.col("disagreements") > 1)),
            "source": F.when(F.col("_third"), "digit_cnn+trocr+vlm")
            .when(F.col("_strip") & (F.col("overrides") > 0), "digit_cnn+trocr")
            .when(F.col("_strip"), "digit_cnn(trocr_confirmed)")
            .otherwise("digit_cnn"),
        }
    ).drop("_c", "_t", "_v", "_d", "_strip", "_third")
