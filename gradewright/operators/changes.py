"""Overrides and approvals: history, current state, audit.

Feeds carry ``change_id``, a whole number that orders the changes. Base tables
are never edited; the current state is a view of base plus feed, so any state can
be recomputed after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.functions.numeric import round_score, safe_double
from gradewright.operators.running import surrogate_ids
from gradewright.session import dealt

OVERRIDDEN = "overridden"
EXACT = "decimal(18,6)"  # sums of scores and of their changes


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the rows of every re-delivered key, add the new rows."""
    redelivered = incoming.select(*keys).distinct()
    return existing.join(redelivered, list(keys), "left_anti").unionByName(incoming, allowMissingColumns=True)


def replace_subtree(
    existing: dict[str, DataFrame], incoming: dict[str, DataFrame], key: str = "exam_id"
) -> dict[str, DataFrame]:
    """Idempotent re-run: all children of a delivered exam go, the new ones come.

    The delivered exam ids decide for every table, so an exam that came back
    without open questions also loses its old verdicts. Students stay.
    """
    delivered = incoming["exams"].select(key).distinct()
    out = {}
    for name, old in existing.items():
        if name == "students":
            out[name] = old
            continue
        kept = old.join(delivered, [key], "left_anti")
        out[name] = kept.unionByName(incoming[name], allowMissingColumns=True) if name in incoming else kept
    return out


def get_or_create_students(students: DataFrame, numbers: DataFrame, number: str = "student_number") -> DataFrame:
    """Students table (student_id, student_number) extended by unseen numbers."""
    unseen = numbers.select(number).where(F.col(number).isNotNull()).distinct().join(students, number, "left_anti")
    highest = students.agg(F.coalesce(F.max("student_id"), F.lit(0))).scalar()
    created = surrogate_ids(unseen, number, "_n").select(
        (highest + F.col("_n")).cast("bigint").alias("student_id"), number
    )
    return students.select("student_id", number).unionByName(created)


def unmatched(changes: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes that name no existing row; they have no effect."""
    return changes.join(target.select(*keys), list(keys), "left_anti")


def override_history(questions: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per effective override with the score, status and flag it replaced."""
    keys = list(keys)
    base = questions.select(
        *keys,
        safe_double("score").alias("_score"),
        F.col("status").alias("_status"),
        F.coalesce("needs_review", F.lit(False)).alias("_review"),
    )
    effective = overrides.withColumn("new_score", safe_double("new_score")).join(base, keys)
    # the overrides of one question of one paper are few, so one window orders them
    before = Window.partitionBy(*keys).orderBy("change_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = effective.withColumn("_prev", F.last("new_score", ignorenulls=True).over(before))
    again = F.col("_prev").isNotNull()
    return prior.select(
        *overrides.columns,
        F.coalesce("_prev", "_score").alias("old_score"),
        F.when(again, OVERRIDDEN).otherwise(F.col("_status")).alias("old_status"),
        F.when(again, F.lit(False)).otherwise(F.col("_review")).alias("old_needs_review"),
    )


def latest(changes: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Last change per key."""
    best = changes.groupBy(*keys).agg(F.max_by(F.struct("change_id", *values), "change_id").alias("_l"))
    return best.select(*keys, *[F.col(f"_l.{v}").alias(f"last_{v}") for v in ("change_id", *values)])


def current_questions(questions: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Question results with the latest override applied."""
    last = latest(overrides.withColumn("new_score", safe_double("new_score")), keys, "new_score")
    hit = F.col("last_change_id").isNotNull()
    return questions.join(last, list(keys), "left").select(
        *[c for c in questions.columns if c not in ("score", "status", "needs_review")],
        F.when(hit, F.col("last_new_score")).otherwise(F.col("score")).alias("score"),
        F.when(hit, F.lit(OVERRIDDEN)).otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(False)).otherwise(F.col("needs_review")).alias("needs_review"),
        F.col("last_change_id").alias("overridden_by"),
    )


def recomputed_totals(current: DataFrame, result_keys: Sequence[str]) -> DataFrame:
    """Totals after overrides. Not rounded, unlike a first grading."""
    return current.groupBy(*result_keys).agg(
        F.sum(F.coalesce("score", F.lit(0.0))).alias("new_total"),
        F.bool_or(F.coalesce("needs_review", F.lit(False))).alias("any_review"),
        F.max("overridden_by").alias("last_override"),
    )


def current_total() -> Column:
    """``current_results``' total as an aggregate of a paper's current questions: rounded like a first grading if none is overridden,
    else not rounded."""
    total = F.sum(F.coalesce("score", F.lit(0.0)))
    return F.when(F.max("overridden_by").isNotNull(), total).otherwise(round_score(total)).alias("total_score")


def approval_history(
    exam_results: DataFrame,
    questions: DataFrame,
    history: DataFrame,
    approvals: DataFrame,
    result_keys: Sequence[str],
) -> DataFrame:
    """One row per effective approval with the values it replaced.

    A missing final score is the total of that moment: the stored total, or, once
    something was overridden, the sum of the questions plus all score changes up
    to then. Sums are decimals, so they do not depend on the order of addition. The
    changes of one paper are few, so one window orders them.
    """
    keys = list(result_keys)
    base = questions.groupBy(*keys).agg(F.sum(safe_double("score").cast(EXACT)).alias("_sum"))
    effective = approvals.join(exam_results.select(*keys, F.col("total_score").alias("_total")), keys).join(
        base, keys, "left"
    )
    moves = history.select(*keys, "change_id", (F.col("new_score").cast(EXACT) - F.col("old_score").cast(EXACT)).alias("_move"))
    feed = effective.unionByName(moves, allowMissingColumns=True)
    is_move = F.col("_move").isNotNull()
    upto = Window.partitionBy(*keys).orderBy("change_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = feed.withColumns(
        {"_moved": F.coalesce(F.sum("_move").over(upto), F.lit(0)), "_moves": F.count_if(is_move).over(upto)}
    ).where(F.col("_move").isNull())
    total = F.when(F.col("_moves") > 0, (F.col("_sum") + F.col("_moved")).cast("double")).otherwise(F.col("_total"))
    scored = carried.withColumn("final_score", F.coalesce(F.col("final_score").try_cast("double"), total))
    value = F.struct("status", "final_score", "approved_by")
    before = Window.partitionBy(*keys).orderBy("change_id")
    prior = scored.withColumn("_old", F.lag(value).over(before))
    return prior.select(*approvals.columns, F.col("_old").alias("old_value"))


def change_events(
    exam_results: DataFrame,
    questions: DataFrame,
    overrides: DataFrame,
    approvals: DataFrame,
    result_keys: Sequence[str],
    number: str = "q_num",
    rows: int = 0,
) -> DataFrame:
    """Results, questions and their changes in one pass per paper, in the order of ``change_id``.

    All rows are dealt out by paper once and sorted twice, by question and by time. ``kind`` is ``result``, ``question``, ``override`` or ``approval``;
    changes that name no existing row are gone. An override carries the ``old_score``, ``old_status`` and ``old_needs_review`` it replaced, an approval its
    ``final_score`` (the total of that moment where none is given) and the ``old_value`` it replaced; every row has ``so_far``, the paper's
    sum at that moment, and ``moved``, the overrides up to then. The changes of one paper are few by nature. ``rows``, about how many there
    are in all, bounds the rows of a task (``session.dealt``).
    """
    keys = list(result_keys)
    base = exam_results.select(*keys, F.lit("result").alias("kind"), F.struct("total_score").alias("stored"))
    asked = questions.select(
        *keys, number, F.lit("question").alias("kind"), safe_double("score").alias("new_score"), "status", F.coalesce("needs_review", F.lit(False)).alias("review")
    )
    moved = overrides.select(
        *keys, number, F.lit("override").alias("kind"), "change_id", safe_double("new_score").alias("new_score"), F.lit(OVERRIDDEN).alias("status"),
        F.lit(False).alias("review"), "reason", "teacher",
    )
    given = approvals.select(*keys, F.lit("approval").alias("kind"), "change_id", "status", F.col("final_score").try_cast("double").alias("final_score"), "approved_by")
    feed = base
    for part in (asked, moved, given):
        feed = feed.unionByName(part, allowMissingColumns=True)
    kind = F.col("kind")
    # base rows have no change_id and stand first
    by_question = Window.partitionBy(*keys, number).orderBy(F.col("change_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    scored = kind.isin("question", "override")
    known = F.last(F.when(scored, F.struct("new_score", "status", "review")), ignorenulls=True).over(by_question)
    exists = F.last(F.when(kind == "question", F.lit(True)), ignorenulls=True).over(by_question)
    prior = dealt(feed, keys, rows).withColumns({"old": known, "exists": exists}).where((kind != "override") | F.col("exists"))

    upto = Window.partitionBy(*keys).orderBy(F.col("change_id").asc_nulls_first())
    exact = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast(EXACT)
    move = F.when(kind == "question", exact("new_score")).when(kind == "override", exact("new_score") - exact("old.new_score"))
    row = F.struct("status", "final_score", "approved_by")
    timed = prior.withColumns(
        {
            "so_far": F.sum(move).over(upto),
            "moved": F.count_if(kind == "override").over(upto),
            "total": F.last("stored", ignorenulls=True).over(upto),
        }
    ).where((kind.isin("question", "override")) | F.col("total").isNotNull())
    moment = F.when(F.col("moved") > 0, F.coalesce("so_far", F.lit(0)).cast("double")).otherwise(F.col("total.total_score"))
    final = F.when(kind == "approval", F.coalesce("final_score", moment))
    strictly = Window.partitionBy(*keys).orderBy(F.col("change_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return timed.withColumn("final_score", final).select(
        *keys, number, "kind", "change_id", "new_score", "status", "review", "reason", "teacher", "final_score", "approved_by", "so_far", "moved",
        F.when(kind == "override", F.col("old.new_score")).alias("old_score"), F.when(kind == "override", F.col("old.status")).alias("old_status"),
        F.when(kind == "override", F.col("old.review")).alias("old_needs_review"), F.col("total.total_score").alias("stored_total"),
        F.when(kind == "approval", F.last(F.when(kind == "approval", row), ignorenulls=True).over(strictly)).alias("old_value"),
    )


def results_after(events: DataFrame, exam_results: DataFrame, result_keys: Sequence[str], number: str = "q_num") -> DataFrame:
    """Exam results after the changes of ``change_events``, as ``current_results`` gives them: events are folded by question, then by paper, where
    they lie."""
    keys, kind = list(result_keys), F.col("kind")
    per_question = events.groupBy(*keys, number).agg(
        F.bool_or(F.when(kind == "question", F.col("review"))).alias("review"),
        F.max(F.when(kind == "override", F.col("change_id"))).alias("last_override"),
        F.max(F.when((kind == "approval") & (F.col("status") == "approved"), F.col("change_id"))).alias("cleared"),
        F.sum(F.when(kind == "question", F.coalesce("new_score", F.lit(0.0)).cast(EXACT)).when(kind == "override", F.coalesce("new_score", F.lit(0.0)).cast(EXACT) - F.coalesce("old_score", F.lit(0.0)).cast(EXACT))).alias("sum"),
    )
    per_paper = per_question.groupBy(*keys).agg(
        F.bool_or(F.coalesce("review", F.lit(False)) & F.col("last_override").isNull()).alias("_any"),
        F.max("last_override").alias("_last"), F.max("cleared").alias("_cleared"), F.sum("sum").cast("double").alias("_sum"),
    )
    touched = F.col("_last").isNotNull()
    cleared = F.coalesce(F.col("_cleared") > F.coalesce("_last", F.lit(-1).cast("bigint")), F.lit(False))
    kept = [c for c in exam_results.columns if c not in ("total_score", "needs_review")]
    return exam_results.join(per_paper, keys, "left").select(
        *kept,
        F.when(touched, F.col("_sum")).otherwise(F.col("total_score")).alias("total_score"),
        F.when(cleared, F.lit(False)).when(touched, F.col("_any")).otherwise(F.col("needs_review")).alias("needs_review"),
    )


def audit_of(events: DataFrame, override_row: Column, approval_row: Column) -> DataFrame:
    """The journal of both kinds of change, in one projection."""
    is_override = F.col("kind") == "override"
    old, taken = F.col("old_value"), F.col("old_value").isNotNull()
    was = F.when(is_override, _json(score=F.col("old_score"), status=F.col("old_status"), needsReview=F.col("old_needs_review"))).when(
        taken, _json(status=old["status"], finalScore=old["final_score"], approvedBy=old["approved_by"])
    )
    now = F.when(is_override, _json(score=F.col("new_score"), status=F.lit(OVERRIDDEN), needsReview=F.lit(False), reason=F.col("reason"))).otherwise(
        _json(status=F.col("status"), finalScore=F.col("final_score"), approvedBy=F.col("approved_by"))
    )
    return events.where(F.col("kind").isin("override", "approval")).select(
        "change_id",
        F.when(is_override, "question_results").otherwise("final_approvals").alias("table_name"),
        F.when(is_override, override_row.cast("string")).otherwise(approval_row.cast("string")).alias("row_id"),
        F.when(is_override, "teacher_override").otherwise("final_approval").alias("action"),
        was.alias("old_value_json"),
        now.alias("new_value_json"),
        F.when(is_override, F.col("teacher")).otherwise(F.col("approved_by")).alias("created_by"),
    )


def final_approvals(approved: DataFrame, existing: DataFrame | None, result_keys: Sequence[str]) -> DataFrame:
    """One row per approved result: the latest approval, else the stored one."""
    keys = list(result_keys)
    new = latest(approved, keys, "status", "final_score", "approved_by").select(
        *keys,
        F.col("last_status").alias("status"),
        F.col("last_final_score").alias("final_score"),
        F.col("last_approved_by").alias("approved_by"),
    )
    if existing is None:
        return new
    old = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("status", "final_score", "approved_by")])
    return new.join(old, keys, "full_outer").select(
        *keys, *[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in ("status", "final_score", "approved_by")]
    )


def current_results(
    exam_results: DataFrame,
    current: DataFrame,
    approved: DataFrame | None,
    result_keys: Sequence[str],
) -> DataFrame:
    """Exam results with recomputed totals and review flags.

    An override recomputes both; an approval with status ``approved`` clears the
    flag. Whichever came last decides about the flag.
    """
    keys = list(result_keys)
    totals = recomputed_totals(current, keys)
    out = exam_results.join(totals, keys, "left")
    if approved is not None:
        cleared = (
            approved.where(F.col("status") == "approved").groupBy(*keys).agg(F.max("change_id").alias("_cleared"))
        )
        out = out.join(cleared, keys, "left")
    else:
        out = out.withColumn("_cleared", F.lit(None).cast("bigint"))
    touched = F.col("last_override").isNotNull()
    cleared_last = F.coalesce(F.col("_cleared") > F.coalesce("last_override", F.lit(-1).cast("bigint")), F.lit(False))
    kept = [c for c in exam_results.columns if c not in ("total_score", "needs_review")]
    return out.select(
        *kept,
        F.when(touched, F.col("new_total")).otherwise(F.col("total_score")).alias("total_score"),
        F.when(cleared_last, F.lit(False))
        .when(touched, F.col("any_review"))
        .otherwise(F.col("needs_review"))
        .alias("needs_review"),
    )


def bulk_approval(exam_results: DataFrame, condition: Column, approved_by: str, first_id: int, order: str) -> DataFrame:
    """Approval feed for every exam result that meets the condition."""
    from gradewright.operators.running import row_numbers

    chosen = row_numbers(exam_results.where(condition), order, "_n")
    return chosen.select(
        *[c for c in exam_results.columns if c not in ("total_score", "needs_review", "status")],
        (F.lit(first_id) + F.col("_n") - 1).cast("bigint").alias("change_id"),
        F.lit("approved").alias("status"),
        F.lit(None).cast("double").alias("final_score"),
        F.lit(approved_by).alias("approved_by"),
    )


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def override_audit(history: DataFrame, row_id: Column) -> DataFrame:
    return history.select(
        F.col("change_id"),
        F.lit("question_results").alias("table_name"),
        row_id.cast("string").alias("row_id"),
        F.lit("teacher_override").alias("action"),
        _json(
            score=F.col("old_score"), status=F.col("old_status"), needsReview=F.col("old_needs_review")
        ).alias("old_value_json"),
        _json(
            score=F.col("new_score"), status=F.lit(OVERRIDDEN), needsReview=F.lit(False), reason=F.col("reason")
        ).alias("new_value_json"),
        F.col("teacher").alias("created_by"),
    )


def approval_audit(approved: DataFrame, row_id: Column) -> DataFrame:
    old = F.col("old_value")
    return approved.select(
        F.col("change_id"),
        F.lit("final_approvals").alias("table_name"),
        row_id.cast("string").alias("row_id"),
        F.lit("final_approval").alias("action"),
        F.when(
            old.isNotNull(),
            _json(status=old["status"], finalScore=old["final_score"], approvedBy=old["approved_by"]),
        ).alias("old_value_json"),
        _json(
            status=F.col("status"), finalScore=F.col("final_score"), approvedBy=F.col("approved_by")
        ).alias("new_value_json"),
        F.col("approved_by").alias("created_by"),
    )


# ---- constraints ------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child keys without a parent row."""
    return child.select(*keys).distinct().join(parent.select(*keys), list(keys), "left_anti")


def violations(df: DataFrame, table: str, rule: str, keys: Sequence[str], n: Column | None = None) -> DataFrame:
    """Report rows of a constraint check instead of an abort."""
    return df.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("row_key"),
        (n if n is not None else F.lit(1)).cast("bigint").alias("n"),
    )


def validate_store(tables: dict[str, DataFrame], rows: int = 0) -> DataFrame:
    """Every violated uniqueness and reference rule of the store. ``rows``, those of the largest table, bounds the rows of a task
    (``session.dealt``): keys are packed so small that merged parts would hold millions."""
    unique = {
        "exams": ["exam_id"],
        "students": ["student_number"],
        "exam_results": ["exam_id", "student_number"],
        "question_results": ["exam_id", "student_number", "q_num"],
        "final_approvals": ["exam_id", "student_number"],
    }
    refers = [
        ("exam_results", "exams", ["exam_id"]),
        ("exam_results", "students", ["student_number"]),
        ("question_results", "exam_results", ["exam_id", "student_number"]),
        ("ocr_outputs", "question_results", ["exam_id", "student_number", "q_num"]),
        ("llm_evaluations", "question_results", ["exam_id", "student_number", "q_num"]),
        ("teacher_overrides", "question_results", ["exam_id", "student_number", "q_num"]),
        ("final_approvals", "exam_results", ["exam_id", "student_number"]),
    ]
    keyed = lambda t, k: dealt(tables[t].select(*k), k, rows)
    parts = [
        violations(duplicate_keys(keyed(t, k), k), t, "unique", k, F.col("n")) for t, k in unique.items() if t in tables
    ]
    parts += [
        violations(orphans(keyed(c, k), keyed(p, k), k), c, f"refers to {p}", k)
        for c, p, k in refers
        if c in tables and p in tables
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
