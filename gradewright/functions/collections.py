"""Arrays and maps: set algebra, orderings, answer cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewright.functions.numeric import col_of, safe_double


def record(**fields) -> Column:
    """A struct with fixed field names, also inside lambdas (where aliases get lost)."""
    parts = []
    for name, value in fields.items():
        parts += [F.lit(name), value]
    return F.named_struct(*parts)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used.

    Spark evaluates a repeated sub-expression again at every use inside a lambda;
    a lambda variable is evaluated once.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty_array() -> Column:
    return F.array().cast("array<string>")


def or_empty(values) -> Column:
    return F.coalesce(col_of(values), empty_array())


def hits(selected, expected) -> Column:
    return F.array_sort(F.array_intersect(or_empty(selected), or_empty(expected)))


def surplus(selected, expected) -> Column:
    return F.array_sort(F.array_except(or_empty(selected), or_empty(expected)))


def same_set(a, b) -> Column:
    # any one order will do here, and sort_array needs no comparing lambda
    return F.sort_array(F.array_distinct(or_empty(a))) == F.sort_array(F.array_distinct(or_empty(b)))


def joined(values, sep: str = ", ") -> Column:
    return F.array_join(col_of(values), sep)


def question_order(number) -> list[Column]:
    """Sort columns: whole numbers by value first, everything else as text."""
    q = col_of(number)
    as_int = q.try_cast("bigint")
    return [as_int.isNull(), as_int, q]


def cell_order(key) -> Column:
    """Digit-only keys sort by value, any other key as 0."""
    k = col_of(key)
    return F.when(k.rlike(r"^\d+$"), F.coalesce(k.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0)).cast(
        "bigint"
    )


def mean_of_map(values) -> Column:
    """Mean of a map's values, null for a missing or empty map."""
    v = F.map_values(col_of(values))
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + safe_double(x))
    return total / F.nullif(F.size(v), F.lit(0))


def allowed_letters(matches) -> Column:
    """Upper-cased single letters of an answer-key map; null when unrestricted."""
    letters = F.filter(F.map_values(col_of(matches)), lambda x: x.rlike(r"^\p{L}$"))
    letters = F.array_distinct(F.transform(letters, F.upper))
    return F.when(F.size(letters) > 0, letters)


def first_bullets(lines, n: int = 3) -> Column:
    return F.slice(col_of(lines), 1, n)


def map_keeping_last(keys: Column, values: Column) -> Column:
    """A map from two arrays; of repeated keys the last one wins (Spark would fail). The keys are computed once, not for every entry."""

    def last_only(keys: Column) -> Column:
        entries = F.zip_with(keys, values, lambda k, v: record(key=k, value=v))
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))

    return bind(keys, last_only)
