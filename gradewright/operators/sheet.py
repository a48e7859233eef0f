"""Score sheets: long results to the wide sheet, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.space import strip
from gradewright.functions.numeric import confidence_is_low, confidence_percent, percent, round_score
from gradewright.functions.text import detail_cells, detail_choice, highlight_class
from gradewright.operators.judging import recovered_review, recovered_status, review_on_sheet
from gradewright.settings import DEFAULTS, Thresholds


def score_sheet(
    students: DataFrame,
    questions: DataFrame,
    numbers: Sequence[str],
    keys: Sequence[str] = ("exam_id", "student_number"),
    row_no: str = "row_no",
    classes: bool = False,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """One row per student: #, number, confidence, three columns per question, totals.

    ``students`` carries ``row_no``, ``number_confidence``, ``total_score`` and
    ``total_max_points``. The question list is explicit: the pivot needs no extra
    pass and the columns keep their order. A question that is missing shows score 0
    and confidence 0, and so puts the student on review.
    """
    listed = questions.where(F.col("q_num").isin(*numbers)) if numbers else questions.where(F.lit(False))
    wide = listed.groupBy(*keys).pivot("q_num", list(numbers)).agg(F.first(_cell()))
    return sheet_rows(students.join(wide, list(keys), "left"), numbers, keys, row_no, classes, cfg)


def _cell() -> Column:
    """What a sheet shows of one question."""
    return F.struct(
        F.col("score").alias("score"),
        F.coalesce("confidence", F.lit(0.0)).alias("conf"),
        F.coalesce(F.col("explanation"), F.col("status"), F.lit("")).alias("detail"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("needs_review", F.lit(False)).alias("flag"),
    )


def paper_cells(questions: DataFrame, numbers: Sequence[str], keys: Sequence[str], *totals: Column) -> DataFrame:
    """One row per paper: a cell per listed question, as in ``score_sheet``, and ``totals``, aggregates of all its questions. One pass, so
    that the questions are dealt out once for both."""
    cells = [F.first(F.when(F.col("q_num") == q, _cell()), ignorenulls=True).alias(q) for q in numbers]
    return questions.groupBy(*keys).agg(*cells, *totals)


def sheet_rows(
    joined: DataFrame, numbers: Sequence[str], keys: Sequence[str], row_no: str = "row_no", classes: bool = False, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """The sheet of students with their cells."""
    columns, review = [], F.lit(False)
    for q in numbers:
        c = F.col(f"`{q}`")
        columns += [
            F.coalesce(c["score"], F.lit(0.0)).alias(f"Q{q} Score"),
            confidence_percent(c["conf"]).alias(f"Q{q} Conf"),
            F.coalesce(c["detail"], F.lit("")).alias(f"Q{q} Detail"),
        ]
        if classes:
            columns += [
                highlight_class(F.coalesce(c["status"], F.lit("unknown"))).alias(f"Q{q} Class"),
                confidence_is_low(c["conf"], cfg).alias(f"Q{q} Low"),
            ]
        review = review | review_on_sheet(c["flag"], c["conf"], cfg)
    return joined.select(
        *[k for k in keys if k != "student_number"],
        F.col(row_no).alias("#"),
        F.col("student_number").alias("Student Number"),
        confidence_percent("number_confidence").alias("SN Confidence"),
        *columns,
        round_score("total_score").alias("Total Score"),
        F.col("total_max_points").alias("Max Points"),
        percent("total_score", "total_max_points").alias("Percentage"),
        F.when(review, "YES").otherwise("").alias("Needs Review"),
    )


def unpivot_sheet(sheet: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """Wide sheet to one row per student and question with a score."""
    head = ["exam_id"] if "exam_id" in sheet.columns else []
    parts = [
        F.struct(
            F.lit(q).alias("q_num"),
            F.col(f"`Q{q} Score`").try_cast("double").alias("score"),
            (F.coalesce(F.col(f"`Q{q} Conf`").try_cast("double"), F.lit(0.0)) / 100).alias("confidence"),
            F.coalesce(F.col(f"`Q{q} Detail`"), F.lit("")).alias("detail"),
        )
        for q in numbers
    ]
    return (
        sheet.where(F.col("`#`").isNotNull())
        .select(
            *head,
            strip(F.coalesce(F.col("`Student Number`").cast("string"), F.lit(""))).alias("student_number"),
            (F.coalesce(F.col("`SN Confidence`").try_cast("double"), F.lit(0.0)) / 100).alias("number_confidence"),
            F.col("`Needs Review`").alias("sheet_review"),
            F.inline(F.array(*parts)),
        )
        .where(F.col("score").isNotNull())
    )


def recover_results(
    long: DataFrame, key: DataFrame, on: Sequence[str] = ("q_num",), keep_wrong: bool = False, cfg: Thresholds = DEFAULTS
) -> DataFrame:
    """Question results rebuilt from a sheet and the answer key (q_num, q_type,
    points). ``keep_wrong`` reads also the cells and letters the plain patterns lose."""
    rows = long.join(key.select(*on, "q_type", F.col("points").alias("max_points")), list(on))
    cells = detail_cells("detail", keep_wrong)
    return rows.select(
        *[c for c in long.columns if c not in ("detail", "sheet_review")],
        "q_type",
        "max_points",
        recovered_status("q_type", "score", "max_points").alias("status"),
        recovered_review("q_type", "confidence", "sheet_review", cfg).alias("needs_review"),
        F.when(F.col("q_type").isin("matching", "fill_blanks") & (F.size(cells) > 0), cells).alias("ocr_answers"),
        F.when(F.col("q_type") == "multiple_choice", detail_choice("detail", keep_wrong)).alias("selected_option"),
        F.col("detail").alias("explanation"),
    )
