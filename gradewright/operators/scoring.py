"""Score rules per question type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.space import strip
from gradewright.functions.collections import cell_order, hits, joined, or_empty, surplus
from gradewright.functions.numeric import round_half_up, round_score, safe_double
from gradewright.functions.similarity import is_fuzzy_match, rounded_similarity, similarity
from gradewright.settings import DEFAULTS, Thresholds


def _text(x: Column) -> Column:
    return x.cast("string")


def score_single(
    df: DataFrame, points="points", penalty="penalty", key="correct_option"
) -> DataFrame:
    """Adds score, max_points, status, review and explanation to a classified
    single choice. The penalty never lowers the score below 0 and so has no
    effect on it; the explanation still names it."""
    p, pen = safe_double(points), safe_double(penalty)
    sel, blank = F.col("selected"), F.coalesce(F.col("is_blank"), F.lit(False))
    right = F.coalesce(sel == F.col(key), F.lit(False))
    open_ = ~blank & sel.isNull()
    status = (
        F.when(blank, "blank").when(open_, "pending_review").when(right, "correct").otherwise("wrong")
    )
    score = F.when(~blank & right, p).otherwise(F.lit(0.0))
    ending = F.concat(F.lit(" Score: "), _text(score), F.lit("/"), _text(p), F.lit("."))
    marks = F.col("explanation") if "explanation" in df.columns else F.lit(None).cast("string")
    text = (
        F.when(blank, F.lit("Blank — no answer marked. Score: 0."))
        .when(open_, F.coalesce(marks, F.lit("Ambiguous mark.")))
        .when(right, F.concat(F.lit("Correct ("), sel, F.lit(")."), ending))
        .otherwise(
            F.concat(
                F.lit("Wrong — chose "),
                sel,
                F.lit(", answer is "),
                F.coalesce(F.col(key), F.lit("None")),
                F.lit("."),
                F.when(pen > 0, F.concat(F.lit(" Penalty: -"), _text(pen), F.lit("."))).otherwise(F.lit("")),
                ending,
            )
        )
    )
    return df.withColumns(
        {
            "score": round_score(score),
            "max_points": p,
            "status": status,
            "needs_review": open_,
            "explanation": text,
        }
    )


def score_multi(df: DataFrame, points="points", penalty="penalty", key="correct_options") -> DataFrame:
    """Adds score, status and the three option lists to a classified multi-select.

    Every right option earns its share; a wrong one costs the penalty, or one
    share when no penalty is set.
    """
    p, pen = safe_double(points), safe_double(penalty)
    sel, want = F.array_distinct(or_empty("selected")), F.array_distinct(or_empty(key))
    df = df.withColumns({"_good": hits(sel, want), "_bad": surplus(sel, want), "_missed": surplus(want, sel)})
    blank = F.coalesce(F.col("is_blank"), F.lit(False))
    good, bad, missed = F.size("_good"), F.size("_bad"), F.size("_missed")
    share = p / F.greatest(F.size(or_empty(key)), F.lit(1))
    cost = F.when((pen == 0) & (bad > 0), share).otherwise(pen)
    score = F.when(blank, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), round_score(good * share - bad * cost))
    )
    parts = F.concat_ws(
        ". ",
        F.when(good > 0, F.concat(F.lit("Correct: "), joined("_good"))),
        F.when(bad > 0, F.concat(F.lit("Wrong: "), joined("_bad"))),
        F.when(missed > 0, F.concat(F.lit("Missed: "), joined("_missed"))),
    )
    text = F.concat(
        F.lit("Selected ["),
        joined(F.array_sort(sel)),
        F.lit("], answer ["),
        joined(F.array_sort(want)),
        F.lit("]. "),
        parts,
        F.lit(". Score: "),
        _text(score),
        F.lit("/"),
        _text(p),
        F.lit("."),
    )
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        score.alias("score"),
        p.alias("max_points"),
        F.when(blank, "blank")
        .when((bad == 0) & (missed == 0), "correct")
        .when(good > 0, "partial")
        .otherwise("wrong")
        .alias("status"),
        F.lit(False).alias("needs_review"),
        F.when(blank, F.lit("Blank — no answers marked. Score: 0.")).otherwise(text).alias("explanation"),
        F.when(blank, or_empty(F.lit(None))).otherwise(F.col("_good")).alias("correct_selections"),
        F.when(blank, or_empty(F.lit(None))).otherwise(F.col("_bad")).alias("wrong_selections"),
        F.when(blank, or_empty(F.lit(None))).otherwise(F.col("_missed")).alias("missed"),
    )


def match_cells(
    expected: DataFrame,
    read: DataFrame,
    keys: Sequence[str],
    item: str = "item",
    exact_similarity: bool = True,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Expected cells with what was read there: blank, correct or wrong.

    ``expected`` has keys, item, expected; ``read`` has keys, item, text,
    confidence, needs_review. Unread cells stay as blank ones.
    """
    cells = expected.join(
        read.select(*keys, item, "text", "confidence", "needs_review"), [*keys, item], "left"
    )
    predicted = strip(F.coalesce(F.col("text"), F.lit("")))
    filled = cells.withColumn("predicted", predicted)
    sim = similarity(
        F.when(F.col("predicted") != "", F.col("predicted")), "expected", cfg, decide_only=not exact_similarity
    )
    scored = filled.withColumn("_sim", sim)
    return scored.select(
        *keys,
        item,
        "expected",
        "predicted",
        F.when(F.col("predicted") == "", "blank")
        .when(is_fuzzy_match(F.col("_sim"), cfg), "correct")
        .otherwise("wrong")
        .alias("cell_status"),
        F.when(F.col("predicted") != "", rounded_similarity(F.col("_sim"))).alias("similarity"),
        F.coalesce(F.col("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("needs_review"), F.lit(False)).alias("flagged"),
    )


def lowest_confidence(read: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lowest confidence over all read cells, also those outside the key."""
    return read.groupBy(*keys).agg(F.min("confidence").alias("min_confidence"))


def score_cells(
    questions: DataFrame,
    expected: DataFrame,
    read: DataFrame,
    keys: Sequence[str],
    points: str = "points",
    penalty: str = "penalty",
    item: str = "item",
    explain: bool = False,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Score matching and fill-in questions.

    ``questions`` lists every question to score with its points and penalty, so a
    question without a key still gets its (correct, 0 points) row. The sums are
    combined before the shuffle; with ``explain`` the cells of a question, as
    many as its key has, are also listed in its text.
    """
    keys = list(keys)
    cells = match_cells(expected, read, keys, item, exact_similarity=False, cfg=cfg)
    is_right, is_wrong, is_blank = (F.col("cell_status") == s for s in ("correct", "wrong", "blank"))
    sums = [
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(is_right).alias("n_correct"),
        F.count_if(is_wrong).alias("n_wrong"),
        F.count_if(is_blank).alias("n_blank"),
        F.bool_or("flagged").alias("_flagged"),
    ]
    if explain:
        note = (
            F.when(is_blank, F.concat(F.lit("#"), F.col(item), F.lit(": blank (expected '"), F.col("expected"), F.lit("')")))
            .when(is_right, F.concat(F.lit("#"), F.col(item), F.lit(": '"), F.col("predicted"), F.lit("' = '"), F.col("expected"), F.lit("' [OK]")))
            .otherwise(F.concat(F.lit("#"), F.col(item), F.lit(": '"), F.col("predicted"), F.lit("' != '"), F.col("expected"), F.lit("' [X]")))
        )
        sums.append(
            F.array_sort(F.collect_list(F.struct(cell_order(item).alias("o"), F.col(item).alias("i"), note.alias("t")))).alias(
                "_notes"
            )
        )
    per_question = cells.groupBy(*keys).agg(*sums)
    lowest = lowest_confidence(read, keys)
    joined_up = questions.join(per_question, keys, "left").join(lowest, keys, "left")

    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_items", "n_correct", "n_wrong", "n_blank")}
    p, pen = safe_double(points), safe_double(penalty)
    share = p / F.greatest(n["n_items"], F.lit(1))
    raw = n["n_correct"] * share - n["n_wrong"] * pen
    score = F.greatest(F.lit(0.0), round_score(raw))
    low = F.coalesce(F.col("min_confidence"), F.lit(0.0))
    out = [
        score.alias("score"),
        p.alias("max_points"),
        F.when((n["n_wrong"] == 0) & (n["n_blank"] == 0), "correct")
        .when(n["n_blank"] == n["n_items"], "blank")
        .when(n["n_correct"] > 0, "partial")
        .otherwise("wrong")
        .alias("status"),
        round_half_up(low, 4).alias("confidence"),
        (F.coalesce(F.col("_flagged"), F.lit(False)) | (low < cfg.high_confidence)).alias("needs_review"),
        n["n_correct"].alias("n_correct"),
        n["n_wrong"].alias("n_wrong"),
        n["n_blank"].alias("n_blank"),
    ]
    if explain:
        lines = F.transform(F.col("_notes"), lambda x: x["t"])
        out.append(
            F.concat(
                _text(n["n_correct"]), F.lit("/"), _text(n["n_items"]), F.lit(" correct. "),
                F.coalesce(F.array_join(lines, " | "), F.lit("")),
                F.lit(" Score: "), _text(score), F.lit("/"), _text(p), F.lit("."),
            ).alias("explanation")
        )
    kept = [c for c in questions.columns if c not in ("score", "max_points", "status", "confidence", "needs_review")]
    return joined_up.select(*kept, *out)


def score_open(questions: DataFrame, verdicts: DataFrame, keys: Sequence[str], points: str = "points") -> DataFrame:
    """Open questions take their verdict; without one they wait for a teacher.

    ``verdicts`` has keys, score, status, confidence, needs_review, explanation.
    """
    v = verdicts.select(
        *keys,
        *[F.col(c).alias(f"_{c}") for c in ("score", "status", "confidence", "needs_review", "explanation")],
        F.lit(True).alias("_judged"),
    )
    judged = F.coalesce(F.col("_judged"), F.lit(False))
    return questions.join(v, list(keys), "left").select(
        *questions.columns,
        F.when(judged, safe_double("_score")).otherwise(0.0).alias("score"),
        safe_double(points).alias("max_points"),
        F.when(judged, F.coalesce(F.col("_status"), F.lit("pending_review"))).otherwise("pending_review").alias("status"),
        F.when(judged, safe_double("_confidence")).otherwise(0.0).alias("confidence"),
        F.when(judged, F.coalesce(F.col("_needs_review"), F.lit(True))).otherwise(True).alias("needs_review"),
        F.when(judged, F.coalesce(F.col("_explanation"), F.lit("")))
        .otherwise("Open-ended — awaiting manual review.")
        .alias("explanation"),
    )


RESULT_COLUMNS = ("score", "max_points", "status", "confidence", "needs_review")


def error_rows(questions: DataFrame, keys: Sequence[str], reason: Column, points: str = "points") -> DataFrame:
    """Result rows of questions that could not be scored."""
    return questions.select(
        *keys,
        "q_type",
        F.lit(0.0).alias("score"),
        safe_double(points).alias("max_points"),
        F.lit("error").alias("status"),
        F.lit(0.0).alias("confidence"),
        F.lit(True).alias("needs_review"),
        F.concat(F.lit("Evaluation error: "), reason).alias("explanation"),
    )


def error_papers(papers: DataFrame, position: str, error: str, number: str = "student_number") -> DataFrame:
    """Papers whose evaluation failed, kept with a total of 0 and their error. ``position`` counts papers from 0;
    a paper without a number is ``error_<position + 1>``."""
    failed = papers.where(F.col(error).isNotNull())
    stand_in = F.concat(F.lit("error_"), (F.col(position) + 1).cast("string"))
    return failed.withColumns(
        {
            number: F.coalesce(F.col(number), stand_in),
            "number_confidence": F.lit(0.0),
            "total_score": F.lit(0.0),
            "total_max_points": F.lit(0.0),
        }
    )


def dispatch(questions: DataFrame, rules: dict[str, dict[str, Column]], keys: Sequence[str], points: str = "points") -> DataFrame:
    """Result rows of questions whose evidence stands in the same row: each type's rule gives the result columns, and all types
    are done in one scan. A type without a rule, or with a rule that lacks a column, gives an ``error`` row or a null there."""
    kind = F.coalesce(F.col("q_type"), F.lit("unknown"))
    stray = {
        "score": F.lit(0.0),
        "max_points": safe_double(points),
        "status": F.lit("error"),
        "confidence": F.lit(0.0),
        "needs_review": F.lit(True),
        "explanation": F.concat(F.lit("Evaluation error: no result for type "), kind),
    }
    out = []
    for name, otherwise in stray.items():
        value = otherwise
        for q_type, rule in rules.items():
            value = F.when(F.col("q_type") == q_type, rule.get(name, F.lit(None))).otherwise(value)
        out.append(value.alias(name))
    return questions.select(*keys, "q_type", *out)


def by_type(
    questions: DataFrame,
    branches: dict[str | tuple[str, ...], DataFrame],
    keys: Sequence[str],
    points: str = "points",
) -> DataFrame:
    """One result table from the scored branch of each question type.

    A question whose type has no branch becomes an ``error`` row instead of
    failing the job. A branch of several types is named by a tuple and brings ``q_type``.
    """
    cols = [*keys, "q_type", *RESULT_COLUMNS, "explanation"]
    known = [t for name in branches for t in ((name,) if isinstance(name, str) else name)]
    stray = questions.where(~F.coalesce(F.col("q_type").isin(known), F.lit(False)))
    result = error_rows(
        stray, keys, F.concat(F.lit("no result for type "), F.coalesce(F.col("q_type"), F.lit("unknown"))), points
    ).select(*cols)
    for name, scored in branches.items():
        part = scored.withColumn("q_type", F.lit(name)) if isinstance(name, str) else scored
        if "explanation" not in part.columns:
            part = part.withColumn("explanation", F.lit(None).cast("string"))
        result = result.unionByName(part.select(*cols))
    return result
