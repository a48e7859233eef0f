"""From pages and reader outputs to graded results, as one lazy plan.

Inputs are tables. An exam may hold a third of all papers, so nothing that belongs to papers is dealt out by exam: the answer key is counted
and sent to every task, or, beyond ``KEY_ROWS``, repeated for a few shares of each exam's papers. Every paper is joined with its key once; the
result is kept by question type, and each type reads its own part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import record
from gradewright.functions.text import page_image_name
from gradewright.operators import cohort, marks, paging, readers, rubric, scoring
from gradewright.session import keep
from gradewright.settings import DEFAULTS, Thresholds
from gradewright.sources.exam_map import expected_cells, letter_sets

PAPER = ["exam_id", "student_number"]
ITEM = [*PAPER, "q_num"]


@dataclass
class ReadInputs:
    """Reader outputs of a batch, all keyed by exam_id, student_number, q_num.

    * papers: the students (exam_id, student_number, number_confidence)
    * ratios: option marks (.., letter, ord, ratio)
    * letters: readings of matching cells (.., item, ord, reader, text, confidence)
    * words: readings of blanks (.., item, first_text, first_conf, retry_text,
      retry_conf, third_text, third_conf, is_blank)
    * verdicts: rubric verdicts (.., verdict struct, explanation, failed, crash, wrote)
    """

    papers: DataFrame
    ratios: DataFrame
    letters: DataFrame
    words: DataFrame
    verdicts: DataFrame


def identify_pages(pages: DataFrame, batches: DataFrame, map_pages: DataFrame) -> DataFrame:
    """Student pages of every batch with their map page.

    ``batches`` names the exam (and its pages per paper) of each batch.
    """
    sized = pages.join(batches.select("batch_id", "pages_per_exam"), "batch_id")
    split = paging.split_pages(sized, F.col("pages_per_exam"))
    return paging.pages_in_map(split.join(batches.select("batch_id", "exam_id"), "batch_id"), map_pages)


def page_files(student_pages: DataFrame) -> DataFrame:
    return student_pages.withColumn("image_name", page_image_name("student_number", "exam_page_num"))


KEY_ROWS = 200_000  # of an answer key that are sent to every task
SHARES = 64  # of the papers of an exam, when its key is not


def join_key(facts: DataFrame, key: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of papers with rows of the key of their exam, without dealing papers out by exam. ``key`` is a kept table. Its size is known
    before it is repeated, so the repeated key is merged by hint: Spark would send all of it to the driver and every task."""
    if key.count() <= KEY_ROWS:
        return facts.join(F.broadcast(key), list(on), how)
    shared = key.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).hint("merge")
    share = F.pmod(F.xxhash64("exam_id", "student_number"), F.lit(SHARES)).cast("int")
    return facts.withColumn("_share", share).join(shared, [*on, "_share"], how).drop("_share")


def _choices(asked: DataFrame, answers: DataFrame, options: DataFrame, kind: str) -> DataFrame:
    with_marks = asked.where(F.col("q_type") == kind).join(options, ITEM, "left")
    listed = F.coalesce(F.transform("o", lambda x: record(letter=x["letter"], ratio=x["ratio"].cast("double"))),
                        F.array().cast("array<struct<letter:string,ratio:double>>"))
    keyed = join_key(with_marks, answers, ["exam_id", "q_num"], "left")
    return keyed.select(*ITEM, "points", "penalty", listed.alias("options"), "correct_option", "correct_options")


def grade(dimension: DataFrame, inputs: ReadInputs, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """One result row per paper and question of the map."""
    of_exam = ["exam_id", "q_num"]
    asked_exams = inputs.papers.select("exam_id").distinct()  # maps without papers are left out of the key
    dimension = dimension.select(*of_exam, "q_type", "points", "penalty", "expected").join(asked_exams, "exam_id", "left_semi")
    dimension = keep(dimension, "grade-key")
    answers = dimension.select(*of_exam, F.col("expected.correctOption").alias("correct_option"), F.col("expected.correctOptions").alias("correct_options"))
    every = join_key(inputs.papers.select(*PAPER), dimension.select(*of_exam, "q_type", "points", "penalty"), ["exam_id"])
    every = keep(every, "grade-asked", ["q_type"])

    options = inputs.ratios.groupBy(*ITEM).agg(  # one entry per printed option
        F.array_sort(F.collect_list(F.struct("ord", "letter", "ratio"))).alias("o")
    )
    single = scoring.score_single(marks.classify_single(_choices(every, answers, options, "multiple_choice"), cfg=cfg))
    multi = scoring.score_multi(marks.classify_multi(_choices(every, answers, options, "multi_select"), cfg=cfg))

    key_cells = expected_cells(dimension)
    legal = join_key(inputs.letters, letter_sets(dimension), of_exam, "left")
    voted = readers.letter_vote(
        readers.letter_candidates(legal, "allowed", cfg), [*ITEM, "item"], inputs.letters.select(*ITEM, "item").distinct(), cfg
    )
    keyed = join_key(inputs.words, key_cells, [*of_exam, "item"], "left")
    reading = [*ITEM, "item", "text", "confidence", "needs_review"]
    read = voted.select(*reading).unionByName(readers.word_cascade(keyed, blank="is_blank", cfg=cfg).select(*reading))
    asked = every.where(F.col("q_type").isin("matching", "fill_blanks"))
    wanted = join_key(asked.select(*ITEM), key_cells, of_exam)
    cells = scoring.score_cells(asked.select(*ITEM, "q_type", "points", "penalty"), wanted, read, ITEM, explain=True, cfg=cfg)

    worth = dimension.select(*of_exam, F.col("points").alias("max_points"))
    judged = rubric.post_process(
        rubric.apply_rubric(join_key(inputs.verdicts, worth, of_exam)), failed="failed", crashed="crash", student_text="wrote", cfg=cfg
    )
    open_q = scoring.score_open(every.where(F.col("q_type") == "open_ended").select(*ITEM, "points"), judged, ITEM)

    return scoring.by_type(
        every,
        {"multiple_choice": single, "multi_select": multi, ("matching", "fill_blanks"): cells, "open_ended": open_q},
        ITEM,
    )


def results(papers: DataFrame, graded: DataFrame) -> DataFrame:
    """Exam results of the graded papers."""
    return papers.join(cohort.student_totals(graded, PAPER), PAPER, "left")
