"""Mark classification from dark ratios.

Ratios come as an array of ``struct<letter, ratio>`` in option order: the order
decides ties, and a Spark map would not keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import bind, record, same_set
from gradewright.functions.numeric import col_of
from gradewright.settings import DEFAULTS, Thresholds


def options(**ratios: Column) -> Column:
    """Option array from one column per letter."""
    return F.array(*[record(letter=F.lit(k), ratio=v.cast("double")) for k, v in ratios.items()])


def rounded(opts) -> Column:
    """Ratios to four places. Plain arithmetic: these are shares of pixel counts, four
    per question, and not scores."""
    return F.transform(
        col_of(opts), lambda o: record(letter=o["letter"], ratio=F.floor(o["ratio"] * 10000 + 0.5) / 10000)
    )


def _ratios(opts: Column) -> Column:
    return F.transform(opts, lambda o: o["ratio"])


def top_gap(opts) -> Column:
    """Distance between the two largest ratios; 0.5 when there is one option."""
    ranked = F.sort_array(_ratios(col_of(opts)), asc=False)
    return F.when(F.size(ranked) >= 2, F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))).otherwise(F.lit(0.5))


def single_gap_confidence(gap: Column) -> Column:
    return F.when(gap > 0.25, 0.98).when(gap > 0.15, 0.92).when(gap > 0.08, 0.80).otherwise(0.55)


def multi_gap_confidence(gap: Column) -> Column:
    return F.when(gap > 0.20, 0.95).when(gap > 0.10, 0.85).when(gap > 0.05, 0.70).otherwise(0.50)


def _letters_over(opts: Column, level: float) -> Column:
    return F.transform(F.filter(opts, lambda o: o["ratio"] >= level), lambda o: o["letter"])


def classify_single(df: DataFrame, opts: str = "options", cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Adds selected, is_blank, confidence, needs_review and explanation."""
    o = F.col("_o")
    df = df.withColumn("_o", rounded(opts)).withColumn("_top", F.array_max(_ratios(o)))
    df = df.withColumn("_filled", _letters_over(o, cfg.filled)).withColumn("_gap", top_gap(o))
    top = F.col("_top")
    first_best = F.get(F.filter(o, lambda x: x["ratio"] == top), F.lit(0))["letter"]
    none = F.coalesce(F.size(o), F.lit(0)) == 0
    blank, double, faint = top < cfg.empty, F.size("_filled") > 1, top < cfg.filled
    picked = ~none & ~blank & ~double & ~faint
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.when(picked, first_best).alias("selected"),
        (none | blank).alias("is_blank"),
        F.when(none, 0.0)
        .when(blank, 0.95)
        .when(double, 0.30)
        .when(faint, 0.40)
        .otherwise(single_gap_confidence(F.col("_gap")))
        .alias("confidence"),
        (~none & ~blank & (double | faint)).alias("needs_review"),
        F.when(none, "No options in map.")
        .when(blank, "No answer marked.")
        .when(
            double,
            F.concat(
                F.lit("Multiple marks detected ["),
                F.array_join(F.array_sort("_filled"), ", "),
                F.lit("]. Invalid for MC."),
            ),
        )
        .when(
            faint,
            F.concat(F.lit("Ambiguous mark. Highest fill: "), first_best, F.lit("="), F.format_string("%.2f", top)),
        )
        .otherwise(F.concat(F.lit("Selected "), first_best, F.lit(".")))
        .alias("explanation"),
    )


def classify_multi(df: DataFrame, opts: str = "options", cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Adds selected (array), is_blank, confidence."""
    o = F.col("_o")
    df = df.withColumn("_o", rounded(opts))
    picks = _letters_over(o, cfg.filled)
    marked = _ratios(F.filter(o, lambda x: x["ratio"] >= cfg.filled))
    open_ = _ratios(F.filter(o, lambda x: x["ratio"] < cfg.filled))
    gap = F.coalesce(F.array_min(marked), F.lit(0.0)) - F.coalesce(F.array_max(open_), F.lit(0.0))
    none = F.coalesce(F.size(col_of(opts)), F.lit(0)) == 0  # the given options: a filter on blanks is computed apart
    blank = ~F.exists(o, lambda x: x["ratio"] >= cfg.empty)
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.when(none | blank, F.array().cast("array<string>")).otherwise(picks).alias("selected"),
        (none | blank).alias("is_blank"),
        F.when(none, 0.0).when(blank, 0.95).otherwise(multi_gap_confidence(gap)).alias("confidence"),
    )


def option_verdicts(opts, selected, key) -> Column:
    """Per option, in letter order: was it marked, should it be, is that right."""
    s, k = col_of(selected), col_of(key)
    found = F.transform(
        F.array_sort(F.transform(col_of(opts), lambda o: o["letter"])),
        lambda letter: record(letter=letter, selected=F.array_contains(s, letter), should_be_selected=F.array_contains(k, letter)),
    )
    return F.transform(
        found,
        lambda f: record(
            letter=f["letter"], selected=f["selected"], should_be_selected=f["should_be_selected"], is_correct=f["selected"] == f["should_be_selected"]
        ),
    )


def verdict_counts(verdicts) -> Column:
    v = col_of(verdicts)
    return bind(F.size(F.filter(v, lambda x: x["is_correct"])), lambda right: record(correct=right, wrong=F.size(v) - right))


def selection_is_correct(selected, key) -> Column:
    """Null without a key."""
    k = col_of(key)
    return F.when(F.coalesce(F.size(k), F.lit(0)) > 0, same_set(selected, k))
