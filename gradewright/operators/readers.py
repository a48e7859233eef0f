"""Combining the outputs of several readers of one cell.

Reader outputs are an input table: keys, ``ord`` (order of the readers, decides
ties), ``reader``, ``text``, ``confidence``. Everything here is grouped sums and
arg-max aggregates, combined before the shuffle, so a cell with very many
readings is no heavier than one with five.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.space import is_blank_text, strip
from gradewright.functions.numeric import round_half_up
from gradewright.functions.similarity import agreement, is_fuzzy_match, similarity
from gradewright.functions.text import first_letter
from gradewright.settings import DEFAULTS, Thresholds


def letter_candidates(
    readings: DataFrame, allowed: str | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Readings that may vote: one letter each, inside the allowed set when there
    is one. Classifier noise is dropped under a restriction, line readings count
    at a discount. ``reader`` starts with ``cnn``, ``ocr`` or ``line``.
    """
    legal = F.col(allowed) if allowed else F.lit(None).cast("array<string>")
    is_line = F.col("reader").startswith("line")
    is_cnn = F.col("reader").startswith("cnn")
    # a line reading is searched for its first allowed letter, the others read one letter
    letter = F.when(is_line, first_letter("text", legal)).otherwise(first_letter("text"))
    conf = F.when(is_line, F.col("confidence") * cfg.line_model_discount).otherwise(F.col("confidence"))
    noise = is_cnn & legal.isNotNull() & (F.col("confidence") < cfg.letter_noise_floor)
    out = readings.withColumns({"letter": letter, "confidence": conf})
    return out.where((F.col("letter") != "") & ~noise).where(
        legal.isNull() | F.array_contains(legal, F.col("letter"))
    )


def best_reading(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most confident reading of each cell, the first of equals."""
    rest = [c for c in readings.columns if c not in keys]
    best = readings.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col("confidence"), (-F.col("ord")).alias("o"))).alias("_b")
    )
    return best.select(*keys, "_b.*")


def tally(candidates: DataFrame, keys: Sequence[str], cfg: Thresholds = DEFAULTS) -> DataFrame:
    """Per cell and letter: real votes, first vote, best reading, strong readings."""
    real = F.col("confidence") >= cfg.letter_vote_floor
    strength = F.struct(F.col("confidence"), (-F.col("ord")).alias("o"))
    return candidates.groupBy(*keys, "letter").agg(
        F.count_if(real).alias("votes"),
        F.min(F.when(real, F.col("ord"))).alias("first_vote"),
        F.max(strength).alias("best"),
        F.max_by(F.col("reader"), strength).alias("source"),
    )


def letter_vote(
    candidates: DataFrame, keys: Sequence[str], cells: DataFrame | None = None, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Reconcile the letters read in a cell.

    The most confident reading wins unless another letter has strictly more
    votes. Too small a share of the votes, strong dissent, or a weak lone reader
    put the cell on review. ``cells`` lists all cells; those without any candidate
    come back empty, on review, with confidence 0.3.
    """
    keys = list(keys)
    letters = tally(candidates, keys, cfg)
    row = F.struct("letter", "votes", "best", "source")
    cell = letters.groupBy(*keys).agg(
        F.max_by(row, F.col("best")).alias("_best"),
        F.max_by(
            row, F.when(F.col("votes") > 0, F.struct(F.col("votes"), (-F.col("first_vote")).alias("o")))
        ).alias("_top"),
        F.sum("votes").alias("_votes"),
        F.count_if(F.col("best.confidence") >= cfg.letter_strong_dissent).alias("_strong"),
    )
    outvoted = (
        (F.col("_votes") > 0)
        & (F.col("_top.letter") != F.col("_best.letter"))
        & (F.col("_top.votes") > F.col("_best.votes"))
    )
    cell = cell.withColumn("_win", F.when(outvoted, F.col("_top")).otherwise(F.col("_best")))
    share = F.when(F.col("_votes") > 0, F.col("_top.votes") / F.col("_votes")).otherwise(F.lit(1.0))
    conf = F.col("_win.best.confidence")
    own_strong = F.when(conf >= cfg.letter_strong_dissent, 1).otherwise(0)
    dissent = F.col("_strong") - own_strong > 0
    split, solo = share < cfg.letter_min_share, (F.col("_win.votes") <= 1) & (conf < cfg.letter_solo_low)
    final = (
        F.when(split, F.least(conf, share)).when(dissent, F.least(conf, F.lit(cfg.letter_dissent_cap))).otherwise(conf)
    )
    voted = cell.select(
        *keys,
        F.col("_win.letter").alias("text"),
        round_half_up(F.least(final, F.lit(1.0)), 4).alias("confidence"),
        F.col("_win.source").alias("source"),
        (split | dissent | solo).alias("needs_review"),
        F.when(F.col("_votes") > 0, F.col("_top.votes")).otherwise(F.lit(1)).cast("bigint").alias("agreeing"),
        round_half_up(share, 3).alias("vote_share"),
    )
    if cells is None:
        return voted
    found = F.col("text").isNotNull()
    return cells.select(*keys).join(voted, keys, "left").select(
        *keys,
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("confidence", F.lit(0.3)).alias("confidence"),
        F.coalesce("source", F.lit("all_failed")).alias("source"),
        F.when(found, F.col("needs_review")).otherwise(F.lit(True)).alias("needs_review"),
        F.coalesce("agreeing", F.lit(0)).cast("bigint").alias("agreeing"),
        F.coalesce("vote_share", F.lit(0.0)).alias("vote_share"),
    )


def word_cascade(
    df: DataFrame,
    first=("first_text", "first_conf"),
    retry=("retry_text", "retry_conf"),
    third=("third_text", "third_conf"),
    expected: str = "expected",
    blank: str | None = None,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Pick the reading of a word cell from three readers given as columns.

    A confident first reading is taken when there is no key or it matches the
    key; else the better of first and retry under the same test; else the more
    confident of that and the third reader.
    """
    t1, c1 = F.coalesce(F.col(first[0]), F.lit("")), F.coalesce(F.col(first[1]), F.lit(0.0))
    t2, c2 = F.coalesce(F.col(retry[0]), F.lit("")), F.coalesce(F.col(retry[1]), F.lit(0.0))
    t3, c3 = F.coalesce(F.col(third[0]), F.lit("")), F.coalesce(F.col(third[1]), F.lit(0.0))
    key = F.coalesce(F.col(expected), F.lit(""))
    is_blank = F.coalesce(F.col(blank), F.lit(False)) if blank else F.lit(False)
    retry_wins = (c2 > c1) & ~is_blank_text(t2)
    df = df.withColumns(
        {"_t": F.when(retry_wins, t2).otherwise(t1), "_c": F.when(retry_wins, c2).otherwise(c1)}
    )
    t, c = F.col("_t"), F.col("_c")

    def sure(text: Column, conf: Column) -> Column:
        return (conf >= cfg.high_confidence) & ~is_blank_text(text)

    # similarity only where it decides
    need1, need2 = sure(t1, c1) & (key != ""), sure(t, c) & (key != "")
    sim1 = similarity(F.when(need1, t1), F.when(need1, key), cfg, decide_only=True)
    sim2 = similarity(F.when(need2, t), F.when(need2, key), cfg, decide_only=True)
    df = df.withColumns({"_m1": is_fuzzy_match(sim1, cfg), "_m2": is_fuzzy_match(sim2, cfg)})
    take1 = sure(t1, c1) & ((key == "") | F.col("_m1"))
    take2 = sure(t, c) & ((key == "") | F.col("_m2"))
    empty = (t == "") & (t3 == "")
    text = (
        F.when(is_blank, F.lit(""))
        .when(take1, t1)
        .when(take2, t)
        .when(empty, F.lit(""))
        .when(c >= c3, t)
        .otherwise(t3)
    )
    conf = (
        F.when(is_blank, F.lit(1.0))
        .when(take1, c1)
        .when(take2, c)
        .when(empty, F.greatest(c, c3, F.lit(0.3)))
        .otherwise(round_half_up(F.greatest(c, c3), 4))
    )
    return df.withColumns(
        {
            "text": text,
            "confidence": conf,
            "source": F.when(is_blank, "blank")
            .when(take1 | take2, "trocr")
            .when(empty, "trocr+tesseract")
            .when(c >= c3, "trocr")
            .otherwise("tesseract"),
            "needs_review": ~is_blank & ~take1 & ~take2 & (empty | (F.greatest(c, c3) < cfg.high_confidence)),
            "fallback_used": ~is_blank & ~take1 & ~take2,
        }
    ).drop("_t", "_c", "_m1", "_m2")


def with_agreement(df: DataFrame, a: str, b: str, name: str = "agreement") -> DataFrame:
    return df.withColumn(name, agreement(a, b))


def first_non_empty(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First reading with text, in reader order; if all are empty, an empty text
    with the first reader's confidence."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    got = readings.withColumn("_t", text).groupBy(*keys).agg(
        F.min_by(F.struct(F.col("_t"), F.col("confidence")), F.when(F.col("_t") != "", F.col("ord"))).alias("_hit"),
        F.min_by("confidence", "ord").alias("_first"),
    )
    return got.select(
        *keys,
        F.coalesce(F.col("_hit._t"), F.lit("")).alias("text"),
        F.when(F.col("_hit").isNotNull(), F.col("_hit.confidence")).otherwise(F.col("_first")).alias("confidence"),
    )


def words_to_cell(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Word rows (pos, text, conf 0..100) of a cell: joined text, mean confidence.

    A cell holds the words of one answer box. Negative and unreadable
    confidences do not count; confidences are cut to whole percents.
    """
    conf = F.col("conf").try_cast("double")
    whole = F.when(conf >= 0, F.floor(conf)).when(conf > -1, F.lit(0))
    kept = F.when(~is_blank_text("text"), F.struct("pos", "text"))
    cell = words.groupBy(*keys).agg(
        F.array_sort(F.collect_list(kept)).alias("_w"),
        F.sum(whole).alias("_sum"),
        F.count(whole).alias("_n"),
    )
    return cell.select(
        *keys,
        strip(F.array_join(F.transform("_w", lambda w: w["text"]), " ")).alias("text"),
        F.coalesce(round_half_up(F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)) / 100, 4), F.lit(0.0)).alias(
            "confidence"
        ),
    )


def best_lines(variants: DataFrame, keys: Sequence[str], line: str = "line_no") -> DataFrame:
    """Multi-line answers: best variant per line (has text, confidence, length,
    earliest), lines joined in order, mean confidence of the lines with text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rank = F.struct(
        F.when(~is_blank_text(text), 1).otherwise(0).alias("has"),
        F.col("confidence"),
        F.length(text).alias("len"),
        (-F.col("ord")).alias("o"),
    )
    per_line = variants.groupBy(*keys, line).agg(F.max_by(F.struct(text.alias("t"), F.col("confidence").alias("c")), rank).alias("b"))
    kept = per_line.where(~is_blank_text("b.t"))
    return kept.groupBy(*keys).agg(
        strip(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct(F.col(line), F.col("b.t").alias("t")))), lambda x: x["t"]),
                " ",
            )
        ).alias("text"),
        round_half_up(F.avg("b.c"), 4).alias("confidence"),
    )


def smart_reading(single: DataFrame, variants: DataFrame, keys: Sequence[str], cfg: Thresholds = DEFAULTS) -> DataFrame:
    """A confident single pass stands; other cells take their best lines, if any."""
    sure = (F.col("confidence") >= cfg.multiline_trigger) & ~is_blank_text("text")
    done = single.where(sure)
    hard = single.where(~F.coalesce(sure, F.lit(False)))
    wanted = variants.join(hard.select(*keys), list(keys), "left_semi")
    lines = best_lines(wanted, keys).select(*keys, F.col("text").alias("_t"), F.col("confidence").alias("_c"))
    reread = hard.join(lines, list(keys), "left").select(
        *keys,
        F.coalesce("_t", "text").alias("text"),
        F.coalesce("_c", "confidence").alias("confidence"),
    )
    return done.select(*keys, "text", "confidence").unionByName(reread)
