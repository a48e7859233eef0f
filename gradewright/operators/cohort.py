"""Cohort analytics: totals, summaries, accuracy, distributions, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.functions.collections import question_order
from gradewright.functions.numeric import percent, percent_of_at_least_one, rate, round_half_up, round_score
from gradewright.operators.judging import judged_correct, judged_partial, review_in_store, review_in_summary
from gradewright.operators.running import order_statistics
from gradewright.settings import DEFAULTS, Thresholds


def student_totals(questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score (rounded) and reachable points (not rounded) of each student."""
    return questions.groupBy(*keys).agg(
        round_score(F.sum(F.coalesce("score", F.lit(0.0)))).alias("total_score"),
        F.sum(F.coalesce("max_points", F.lit(0.0))).alias("total_max_points"),
        F.bool_or(F.col("q_type") == "open_ended").alias("had_ai"),
        F.bool_or(review_in_store("needs_review", "status")).alias("needs_review"),
    )


def papers_needing_review(
    questions: DataFrame, exam: Sequence[str], student: Sequence[str], cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Students per exam with a flagged or unsure question."""
    per_student = questions.groupBy(*exam, *student).agg(
        F.bool_or(review_in_summary("needs_review", "confidence", cfg)).alias("_r")
    )
    return per_student.groupBy(*exam).agg(F.count_if("_r").alias("papers_needing_review"))


def exam_summary(totals: DataFrame, exam: Sequence[str], first_by: str) -> DataFrame:
    """Students, mean, best and worst score, and the points of the first student. A paper
    without a total has 0 in all of them."""
    scored = totals.withColumn("total_score", F.coalesce("total_score", F.lit(0.0)))
    return scored.groupBy(*exam).agg(
        F.count(F.lit(1)).alias("students"),
        round_score(F.sum("total_score") / F.count(F.lit(1))).alias("average_score"),
        round_score(F.max("total_score")).alias("highest_score"),
        round_score(F.min("total_score")).alias("lowest_score"),
        F.min_by("total_max_points", first_by).alias("max_points"),
    )


def exam_header(papers: DataFrame, questions: DataFrame, exam: Sequence[str], student: str, number: str = "q_num") -> DataFrame:
    """Numbers of students, with or without questions, and of different questions per exam.

    Each distinct count is two plain aggregates, so no exam is counted in one task.
    """
    students = papers.select(*exam, student).distinct().groupBy(*exam).agg(F.count(F.lit(1)).alias("total_students"))
    numbers = questions.select(*exam, number).distinct().groupBy(*exam).agg(F.count(F.lit(1)).alias("total_questions"))
    total = F.coalesce("total_questions", F.lit(0)).alias("total_questions")
    return students.join(numbers, list(exam), "left").select(*exam, "total_students", total)


def question_numbers(questions: DataFrame, exam: Sequence[str] = (), number: str = "q_num") -> DataFrame:
    """Question numbers in use, in display order (position from 1)."""
    distinct = questions.select(*exam, number).distinct()
    w = Window.partitionBy(*exam).orderBy(*question_order(number))
    return distinct.withColumn("position", F.row_number().over(w))


# ---- accuracy ---------------------------------------------------------------


def judged(questions: DataFrame, has_is_correct: str | None = None) -> DataFrame:
    """Adds is_right and is_partial (partial only when not right)."""
    right = judged_correct(
        "status",
        "q_type",
        "score",
        "max_points",
        has_is_correct,
        "reader_is_correct" if has_is_correct else None,
    )
    return questions.withColumn("is_right", right).withColumn(
        "is_partial", ~F.col("is_right") & judged_partial("status")
    )


def _accuracy_measures(review: str = "needs_review") -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_right").alias("correct"),
        F.count_if("is_partial").alias("partial"),
        F.count_if(F.coalesce(F.col(review), F.lit(False))).alias("needs_review"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "accuracy_pct": rate("correct", "total"),
            "partial_pct": rate("partial", "total"),
            "review_pct": rate("needs_review", "total"),
        }
    )


def accuracy_by(judged_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _with_rates(judged_rows.groupBy(*keys).agg(*_accuracy_measures()))


def accuracy_grouping_sets(judged_rows: DataFrame, exam: str = "exam_id", kind: str = "q_type") -> DataFrame:
    """Per exam, per type and overall from one aggregate. Rows are counted by exam and type first; only those few counts are repeated for
    the three levels."""
    measures = ("total", "correct", "partial", "needs_review")
    cells = judged_rows.groupBy(exam, kind).agg(*_accuracy_measures())
    sets = cells.groupingSets([[F.col(exam)], [F.col(kind)], []], F.col(exam), F.col(kind))
    out = sets.agg(F.grouping_id().alias("_gid"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    level = F.when(F.col("_gid") == 1, "exam").when(F.col("_gid") == 2, "type").otherwise("overall")
    return _with_rates(out.withColumn("level", level)).drop("_gid")


def exam_accuracy(judged_rows: DataFrame, totals: DataFrame, exam: str = "exam_id") -> DataFrame:
    """Accuracy per exam with the mean score percentage of its students."""
    pct = percent_of_at_least_one("total_score", "total_max_points")
    scores = totals.groupBy(exam).agg(
        F.count(F.lit(1)).alias("students"),
        round_half_up(F.sum(pct) / F.count(F.lit(1)), 1).alias("avg_score_pct"),
    )
    return scores.join(accuracy_by(judged_rows, [exam]), exam)


def per_question_status(questions: DataFrame, keys: Sequence[str] = ("q_num",)) -> DataFrame:
    """Status counts and points of every question."""
    counts = {s: F.count_if(F.col("status") == s).alias(s) for s in ("correct", "partial", "blank", "wrong")}
    return (
        questions.groupBy(*keys)
        .agg(
            *counts.values(),
            F.sum(F.coalesce("score", F.lit(0.0))).alias("points"),
            F.sum(F.coalesce("max_points", F.lit(0.0))).alias("max_points"),
        )
        .withColumn("points_pct", percent("points", "max_points", 0))
    )


def overall_points(totals: DataFrame) -> DataFrame:
    return totals.agg(
        F.sum("total_score").alias("earned"), F.sum("total_max_points").alias("possible")
    ).withColumn("pct", percent("earned", "possible"))


# ---- class summary ----------------------------------------------------------


def question_difficulty(questions: DataFrame, exam: Sequence[str], number: str = "q_num") -> DataFrame:
    """Mean percentage and number of students per question; a question whose type
    differs between students takes the smallest type name."""
    pct = F.when(F.col("max_points") > 0, F.col("score") / F.nullif(F.col("max_points"), F.lit(0.0)) * 100).otherwise(0.0)
    return questions.groupBy(*exam, number).agg(
        F.min("q_type").alias("q_type"),
        round_half_up(F.sum(pct) / F.count(F.lit(1)), 1).alias("avg_pct"),
        F.count(F.lit(1)).alias("students"),
    )


def hardest_questions(questions: DataFrame, exam: Sequence[str], k: int = 5, number: str = "q_num") -> DataFrame:
    """The k questions with the lowest mean percentage of every exam, ranked. The report is
    defined as a top k; all questions are compared."""
    w = Window.partitionBy(*exam).orderBy(F.col("avg_pct"), *question_order(number))
    ranked = question_difficulty(questions, exam, number).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def class_summary(
    totals: DataFrame, questions: DataFrame, exam: str = "exam_id", passing: float = 50.0, k: int = 5
) -> DataFrame:
    """One record per exam: size, mean and deviation of the percentages, students
    below the pass mark, and the hardest questions as an array of structs.

    The deviation is the population one, taken from count, sum and sum of squares.
    """
    pct = percent("total_score", "total_max_points", None)
    scored = totals.withColumn("_pct", pct)
    stats = scored.groupBy(exam).agg(
        F.count(F.lit(1)).alias("total_students"),
        round_half_up(F.avg("_pct"), 1).alias("class_mean"),
        round_half_up(F.stddev_pop("_pct"), 1).alias("class_std_dev"),
        F.count_if(F.col("_pct") < passing).alias("below_passing"),
    )
    hard = (
        hardest_questions(questions, [exam], k)
        .groupBy(exam)
        .agg(  # k structs per exam
            F.array_sort(F.collect_list(F.struct("rank", "q_num", "q_type", "avg_pct", "students"))).alias("hardest")
        )
    )
    return stats.join(hard, exam, "left")


# ---- distributions ----------------------------------------------------------


def score_histogram(pcts: DataFrame, value: str = "pct", by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Counts over equal bins of [0, 100]; 100 falls in the last bin. Values below are
    bin -1, values above (an override beyond the maximum) are bin ``bins``."""
    width = 100 / bins
    bucket = F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int")
    bucket = F.when(F.col(value) < 0, -1).when(F.col(value) > 100, bins).otherwise(bucket)
    return pcts.where(F.col(value).isNotNull()).groupBy(*by, bucket.alias("bin")).agg(F.count(F.lit(1)).alias("students"))


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and interpolated median per group."""
    middle = {"_lo": lambda n: F.floor((n + 1) / 2), "_hi": lambda n: F.floor((n + 2) / 2)}
    found = order_statistics(df, value, middle, by)
    return found.select(*by, (F.col("total") / F.col("n")).alias("mean"), ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


# ---- comparisons ------------------------------------------------------------


def last_record_wins(students: DataFrame, keys: Sequence[str], position: str = "student_pos") -> DataFrame:
    rest = [c for c in students.columns if c not in keys]
    best = students.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_r"))
    return best.select(*keys, "_r.*")


def actual_vs_expected(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    return actual.join(expected, list(keys))


def missing_students(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    a, e = actual.select(*keys).distinct(), expected.select(*keys).distinct()
    return (
        e.join(a, list(keys), "left_anti")
        .withColumn("missing_in", F.lit("actual"))
        .unionByName(a.join(e, list(keys), "left_anti").withColumn("missing_in", F.lit("expected")))
    )


def findings(questions: DataFrame, students: DataFrame, keys: Sequence[str], number: str = "q_num") -> DataFrame:
    """Per student the questions that lost points; a student's questions only."""
    lost = F.col("status").isin("partial", "wrong", "blank")
    note = F.concat(F.lit("Q"), F.col(number), F.lit(" ("), F.col("status"), F.lit(")"))
    order = [c.alias(f"o{i}") for i, c in enumerate(question_order(number))]
    losses = (
        questions.where(lost)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(*order, note.alias("note")))).alias("_l"))
    )
    text = F.array_join(F.transform("_l", lambda x: x["note"]), ", ")
    return students.join(losses, list(keys), "left").withColumn(
        "losses", F.coalesce(text, F.lit("no impact"))
    ).drop("_l")


def recovered_mean(totals: DataFrame) -> DataFrame:
    """Mean percentage of a recovered sheet: students without points add nothing
    but still count."""
    pct = F.when(F.col("total_max_points") > 0, F.col("total_score") / F.nullif(F.col("total_max_points"), F.lit(0.0)) * 100)
    return totals.agg(round_half_up(F.sum(pct) / F.nullif(F.count(F.lit(1)), F.lit(0)), 1).alias("average_pct"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
