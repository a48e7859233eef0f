"""Exam map questions as authoring records, and authoring records as a question pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import map_keeping_last, or_empty
from gradewright.functions.numeric import safe_double
from gradewright.functions.text import exam_code_parts, type_code

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letter(i: Column) -> Column:
    return F.substr(F.lit(ALPHABET), (i + 1).cast("int"), F.lit(1))


def _numbered(prefix: str, n: Column, name) -> Column:
    items = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.concat(F.lit(prefix), name(i)))
    return F.when(n > 0, items).otherwise(F.array().cast("array<string>"))


def _slots(m: Column) -> Column:
    """Values of an item map as an array by item number, gaps empty."""
    n = F.coalesce(F.array_max(F.transform(F.map_keys(m), lambda k: k.try_cast("int"))), F.lit(0))
    filled = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.try_element_at(m, i.cast("string")), F.lit(""))
    )
    return F.when(n > 0, filled).otherwise(F.array().cast("array<string>"))


def authoring_records(questions: DataFrame) -> DataFrame:
    """One authoring record per map question.

    ``questions`` has q_num, q_type, question_text, points, penalty, item_count,
    n_options and the key: correct_option, correct_options, correct_cells,
    correct_text. Letters become indices, key maps arrays, absent fields defaults.
    """
    t = F.col("q_type")
    n = F.coalesce("item_count", "n_options", F.lit(0))
    choice = t.isin("multiple_choice", "multi_select")
    cells = F.coalesce(F.col("correct_cells"), F.create_map().cast("map<string,string>"))
    slots = _slots(cells)
    none_s, none_i = F.array().cast("array<string>"), F.array().cast("array<int>")
    option = F.coalesce(F.nullif(F.col("correct_option"), F.lit("")), F.lit("A"))
    known = F.filter(or_empty("correct_options"), lambda a: a.rlike("^[A-Z]$"))
    return questions.select(
        *[c for c in ("exam_id", "page_pos", "q_num") if c in questions.columns],
        F.coalesce(type_code("q_type"), F.lit("open")).alias("type"),
        F.coalesce("question_text", F.concat(F.lit("Question "), F.col("q_num"))).alias("text"),
        F.coalesce(F.col("points"), F.lit(10.0)).cast("int").alias("points"),
        safe_double("penalty").cast("int").alias("penalty_per_item"),
        F.when(choice, _numbered("Option ", n, _letter)).otherwise(none_s).alias("options"),
        F.when((t == "multiple_choice") & option.rlike("^[A-Z]$"), F.instr(F.lit(ALPHABET), option) - 1)
        .otherwise(0)
        .alias("correct_answer"),
        F.when(t == "multi_select", F.transform(known, lambda a: F.instr(F.lit(ALPHABET), a) - 1)).otherwise(none_i).alias("correct_answers"),
        F.when(t == "open_ended", F.coalesce("correct_text", F.lit(""))).otherwise("").alias("correct_text"),
        F.when(t == "matching", _numbered("Item ", F.size(slots), lambda i: (i + 1).cast("string"))).otherwise(none_s).alias("match_left"),
        F.when(t == "matching", _numbered("", F.size(slots), _letter)).otherwise(none_s).alias("match_right"),
        F.when(t == "matching", slots).otherwise(none_s).alias("match_correct"),
        F.when(t == "fill_blanks", F.array_join(F.transform(slots, lambda s: F.lit("___")), " ")).otherwise("").alias("fill_text"),
        F.when(t == "fill_blanks", slots).otherwise(none_s).alias("fill_answers"),
    )


def exam_header(maps: DataFrame) -> DataFrame:
    """Header of an authoring file from a map: codes out of the exam id."""
    parts = exam_code_parts("exam_id")
    return maps.select(
        "exam_id",
        parts["course_code"].alias("course_code"),
        parts["exam_type"].alias("exam_type"),
        F.coalesce("date", F.lit("2026-04-23")).alias("date"),
    )


def _four(options: Column) -> Column:
    o = or_empty(options)
    return F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.coalesce(F.get(o, i), F.concat(F.lit("Option "), (i + 1).cast("string"))),
    )


def _as_letter(v: Column) -> Column:
    """A letter, or an index 0..25 as number or text, as a letter; else null."""
    i = v.try_cast("int")
    return F.when(v.rlike(r"^\p{L}$"), F.upper(v)).when(v.rlike(r"^\d+$") & (i < 26), _letter(i))


def _by_number(values: Column) -> Column:
    keys = F.transform(values, lambda v, i: (i + 1).cast("string"))
    return map_keeping_last(keys, values)


def question_pool(records: DataFrame) -> DataFrame:
    """Authoring records as pool entries: long type, prompt, four options, key."""
    t = F.col("type")
    none_s = F.array().cast("array<string>")
    none_m = F.create_map().cast("map<string,string>")
    ci = F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce("correct_answer", F.lit(0))))
    marked = F.array_sort(
        F.array_distinct(
            F.transform(F.filter(F.coalesce("correct_answers", F.array().cast("array<int>")), lambda i: i.between(0, 3)), _letter)
        )
    )
    blanks = _by_number(or_empty("fill_answers"))
    filled = F.map_filter(blanks, lambda k, v: F.coalesce(v, F.lit("")) != "")
    letters = _by_number(F.transform(or_empty("match_correct"), _as_letter))
    right = or_empty("match_right")
    return records.select(
        *[c for c in ("exam_id", "q_num") if c in records.columns],
        F.when(t == "mc", "multiple_choice")
        .when(t == "ms", "multi_select")
        .when(t == "fill", "fill_blanks")
        .when(t == "match", "matching")
        .when(t == "open", "open_ended")
        .alias("q_type"),
        F.when(t == "fill", F.coalesce(F.nullif("fill_text", F.lit("")), "text")).otherwise(F.col("text")).alias("prompt"),
        F.when(t.isin("mc", "ms"), _four(F.col("options"))).otherwise(none_s).alias("options"),
        F.when(t == "mc", _letter(ci)).alias("correct_option"),
        F.when(t == "ms", F.when(F.size(marked) > 0, marked).otherwise(F.array(F.lit("A")))).otherwise(none_s).alias("correct_options"),
        F.when(t == "fill", F.when(F.size(filled) > 0, filled).otherwise(F.create_map(F.lit("1"), F.lit("answer"))))
        .when(t == "match", F.map_filter(letters, lambda k, v: v.isNotNull()))
        .otherwise(none_m)
        .alias("correct_cells"),
        F.when(t == "match", _by_number(or_empty("match_left"))).otherwise(none_m).alias("left_items"),
        F.when(t == "match", map_keeping_last(F.transform(right, lambda v, i: _letter(i)), right)).otherwise(none_m).alias("right_options"),
        F.when(t == "open", F.coalesce("correct_text", F.lit(""))).alias("expected"),
    ).where(F.col("q_type").isNotNull())
