"""The result tree: nested records per student.

One row per exam result. A whole exam is never nested into one value, because an
exam has no upper size; writers put the student rows of an exam side by side
(``partitionBy("exam_id")``) instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import question_order, record


def result_tree(
    exam_results: DataFrame,
    questions: DataFrame,
    ocr: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    approvals: DataFrame | None = None,
    keys: Sequence[str] = ("exam_id", "student_number"),
    number: str = "q_num",
) -> DataFrame:
    """Student rows with a ``questions`` array, each with its read texts and verdict.

    All tables are laid side by side and dealt out by student once; a student's rows, as many as the exam has questions and answer
    cells, are put together in its own row. A question has one verdict and a student one approval; of several the first by value counts.
    Rows of students without an exam result have no place.
    """
    keys = list(keys)

    def part(df: DataFrame | None, name: str) -> DataFrame | None:
        return None if df is None else df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    parts = {"r": part(exam_results, "r"), "q": part(questions, "q"), "o": part(ocr, "o"), "v": part(verdicts, "v"), "a": part(approvals, "a")}
    parts = {name: df for name, df in parts.items() if df is not None}
    side = None
    for df in parts.values():
        side = df if side is None else side.unionByName(df, allowMissingColumns=True)
    # results stay rows of their own, so that repeated ones are kept
    lists = [F.collect_list(name).alias(name) for name in parts]
    own = side.groupBy(*keys).agg(*lists)

    q_fields = [c for c in questions.columns if c not in (*keys, number)]
    places = lambda q: {f"o{i}": c for i, c in enumerate(question_order(q[number]))}
    ordered = F.transform(F.array_sort(F.transform("q", lambda q: record(**places(q), q=q))), lambda x: x["q"])

    def whole(q):
        fields = {number: q[number], **{c: q[c] for c in q_fields}}
        if ocr is not None:
            mine = F.filter("o", lambda o: o[number].eqNullSafe(q[number]))
            texts = F.array_sort(F.transform(mine, lambda o: record(**{c: o[c] for c in ("output_type", "text", "confidence")})))
            fields["ocr_outputs"] = F.when(F.size(mine) > 0, texts)
        if verdicts is not None:
            names = [c for c in verdicts.columns if c not in (*keys, number)]
            given = F.array_sort(F.transform(F.filter("v", lambda v: v[number].eqNullSafe(q[number])), lambda v: record(**{c: v[c] for c in names})))
            fields["llm_evaluation"] = F.get(given, F.lit(0))
        return record(**fields)

    out = own.select(
        *keys, F.explode("r").alias("r"), F.transform(ordered, whole).alias("questions"),
        *([F.get(F.array_sort("a"), F.lit(0)).alias("final_approval")] if approvals is not None else []),
    )
    columns = [F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in exam_results.columns]
    return out.select(*columns, "questions", *(["final_approval"] if approvals is not None else []))


def newest_first(exams: DataFrame, created: str = "created_at", tie: str = "exam_id") -> DataFrame:
    return exams.orderBy(F.col(created).desc(), F.col(tie).desc())
