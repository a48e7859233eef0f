"""Deterministic student answers for test cohorts.

Archetype A answers everything right, B about 70 %, C 30 % right, 30 % wrong and
40 % blank. Which question gets which treatment is a hash of archetype and
question, so the same input always gives the same cohort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import map_keeping_last, or_empty, record
from gradewright.functions.numeric import hash_bucket

def _abcd() -> Column:
    return F.array(*[F.lit(c) for c in "ABCD"])


def _none_map() -> Column:
    return F.create_map().cast("map<string,string>")


def _half(text: Column, least: int) -> Column:
    n = F.greatest(F.lit(least), F.floor(F.length(text) / 2)).cast("int")
    return F.substr(text, F.lit(1), n)


def _answer(pick=None, picks=None, cells=None, text=None) -> Column:
    return record(
        pick=pick if pick is not None else F.lit(None).cast("string"),
        picks=picks if picks is not None else F.lit(None).cast("array<string>"),
        cells=cells if cells is not None else F.lit(None).cast("map<string,string>"),
        text=text if text is not None else F.lit(None).cast("string"),
    )


def _rotate(letter: Column, by: int) -> Column:
    at = F.greatest(F.array_position(_abcd(), letter) - 1, F.lit(0))
    return F.get(_abcd(), ((at + by) % 4).cast("int"))


def _sorted_keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def _values(m: Column, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.try_element_at(m, k))


def _swap_first_two(m: Column) -> Column:
    keys = _sorted_keys(m)
    values = _values(m, keys)
    swapped = F.concat(
        F.array(F.get(values, F.lit(1)), F.get(values, F.lit(0))), F.slice(values, 3, F.greatest(F.size(values) - 2, F.lit(0)))
    )
    return F.when(F.size(keys) >= 2, map_keeping_last(keys, swapped)).otherwise(m)


def _cycle(m: Column) -> Column:
    keys = _sorted_keys(m)
    values = _values(m, keys)
    n = F.size(values)
    turned = F.concat(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, 1))
    return F.when(n > 0, map_keeping_last(keys, turned)).otherwise(m)


def _shorten_last(m: Column) -> Column:
    last = F.array_max(F.map_keys(m))
    return F.transform_values(m, lambda k, v: F.when(k == last, _half(v, 2)).otherwise(v))


def _drop_last(m: Column) -> Column:
    last = F.array_max(F.map_keys(m))
    return F.map_filter(m, lambda k, v: k != last)


def _by_type(**cases: Column) -> Column:
    t = F.col("q_type")
    out = None
    for name, value in cases.items():
        out = F.when(t == name, value) if out is None else out.when(t == name, value)
    return out


def derive_answers(questions: DataFrame, generator: str = "mock") -> DataFrame:
    """Answers of the three archetypes to every question.

    ``questions`` has q_num, q_type and the key columns correct_option,
    correct_options, correct_cells, correct_text. ``generator`` picks one of the two
    published rule sets: ``mock`` (100 buckets, B truncates a blank) or ``real``
    (10 buckets, B drops a blank; C's wrong answers are B's for question + 100).
    """
    asked = questions.withColumn("archetype", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    option, options = F.col("correct_option"), or_empty("correct_options")
    cells = F.coalesce(F.col("correct_cells"), _none_map())
    text = F.coalesce(F.col("correct_text"), F.lit(""))

    right = _by_type(
        multiple_choice=_answer(pick=option),
        multi_select=_answer(picks=options),
        fill_blanks=_answer(cells=cells),
        matching=_answer(cells=cells),
        open_ended=_answer(text=text),
    )
    extra = F.filter(_abcd(), lambda c: ~F.array_contains(options, c))
    with_extra = F.concat(options, F.slice(extra, 1, 1))
    wrong_b = _by_type(
        multiple_choice=_answer(pick=_rotate(option, 1)),
        multi_select=_answer(picks=with_extra),
        fill_blanks=_answer(cells=_shorten_last(cells) if generator == "mock" else _drop_last(cells)),
        matching=_answer(cells=_swap_first_two(cells)),
        open_ended=_answer(text=_half(text, 20 if generator == "mock" else 15)),
    )
    key = F.concat(F.col("archetype"), F.lit(":"), F.col("q_num"))
    a, b, c = (F.col("archetype") == x for x in "ABC")

    if generator == "mock":
        wrong_c = _by_type(
            multiple_choice=_answer(pick=_rotate(option, 2)),
            multi_select=_answer(picks=F.slice(extra, 1, 2)),
            fill_blanks=_answer(cells=F.transform_values(cells, lambda k, v: F.lit("wrong"))),
            matching=_answer(cells=_cycle(cells)),
            open_ended=_answer(text=F.lit("I don't know")),
        )
        blank = _by_type(
            multiple_choice=_answer(pick=F.lit("")),
            multi_select=_answer(picks=or_empty(F.lit(None))),
            fill_blanks=_answer(cells=F.transform_values(cells, lambda k, v: F.lit(""))),
            matching=_answer(cells=F.transform_values(cells, lambda k, v: F.lit(""))),
            open_ended=_answer(text=F.lit("")),
        )
        h = hash_bucket(key, 100)
        treatment = (
            F.when(a | (b & (h < 70)) | (c & (h < 30)), "right").when(b, "wrong_b").when(h < 60, "wrong_c").otherwise("blank")
        )
        scribbled = F.lit(False)
    else:
        blank = _by_type(
            multiple_choice=_answer(pick=F.lit(None).cast("string")),
            multi_select=_answer(picks=or_empty(F.lit(None))),
            fill_blanks=_answer(cells=_none_map()),
            matching=_answer(cells=_none_map()),
            open_ended=_answer(text=F.lit("")),
        )
        h = hash_bucket(key, 10)
        later = F.concat(F.lit("B:"), (F.col("q_num").try_cast("bigint") + 100).cast("string"))
        wrong_c = F.when(hash_bucket(later, 10) < 7, right).otherwise(wrong_b)
        treatment = (
            F.when(a | (b & (h < 7)) | (c & (h < 3)), "right").when(b, "wrong_b").when(h < 6, "wrong_c").otherwise("blank")
        )
        scribbled = F.coalesce(b & (h % 4 == 0), F.lit(False))
    chosen = asked.withColumn("bucket", h).withColumn("treatment", treatment).withColumn("scribbled", scribbled)
    t = F.col("treatment")
    answer = F.when(t == "right", right).when(t == "wrong_b", wrong_b).when(t == "wrong_c", wrong_c).otherwise(blank)
    return chosen.withColumn("answer", answer)
