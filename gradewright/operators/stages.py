"""Stage log: parse, bracket into batches, attribute, time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.functions.numeric import round_half_up
from gradewright.functions.text import STAGE_FIELDS, STAGE_TAG, stage_field, stage_head, stage_message
from gradewright.operators.running import Measure, order_statistics, running


def with_stage_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """The typed fields of every line, null where it has none."""
    fields = {name: stage_field("_head", name, kind) for name, kind in STAGE_FIELDS}
    return lines.withColumn("_head", stage_head(line)).withColumns({**fields, "msg": stage_message(line)}).drop("_head")


def stage_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with the stage tag, fields typed; other columns pass through."""
    return with_stage_fields(lines.where(F.contains(F.col(line), F.lit(STAGE_TAG))), line)


def _is_start() -> Column:
    return F.coalesce((F.col("stage") == "batch") & (F.col("state") == "start"), F.lit(False))


def _is_end() -> Column:
    return F.coalesce((F.col("stage") == "batch") & (F.col("state") == "end"), F.lit(False))


def bracket_batches(events: DataFrame, order: str = "line_no", by: Sequence[str] = ()) -> DataFrame:
    """Keep the events of closed batches and say where each belongs.

    An event is inside a batch when the nearest bracket before it is a start and
    the nearest after it is an end. A second start discards the open batch; what
    lies outside is dropped. Adds

    * ``batch_start`` (order key of the start line, the batch key), ``batch_end``,
      ``batch_eid`` (from the end line), ``batch_students`` (from the start line),
    * ``student_idx``, ``student_num``: the student last read in the batch. Question
      lines name no student, so this is how they get one.
    """
    at = F.col(order).cast("bigint")
    bracket = F.struct(
        at.alias("at"), _is_start().alias("opens"), F.col("eid").alias("eid"), F.col("sTotal").alias("total")
    )
    if_bracket = F.when(_is_start() | _is_end(), bracket)
    read = F.when(
        (F.col("stage") == "read") & F.col("sIdx").isNotNull(),
        F.struct(at.alias("at"), F.col("sIdx").alias("idx"), F.col("sNum").alias("num")),
    )
    near = running(
        events,
        order,
        [
            Measure("_before", "last", if_bracket, inclusive=False),
            Measure("_after", "last", if_bracket, inclusive=False, backward=True),
            Measure("_read", "last", read),
        ],
        by,
    )
    begin = F.when(_is_start(), bracket).otherwise(F.col("_before"))
    finish = F.when(_is_end(), bracket).otherwise(F.col("_after"))
    inside = F.coalesce(begin["opens"], F.lit(False)) & ~F.coalesce(finish["opens"], F.lit(True))
    of_batch = F.col("_read.at") > begin["at"]
    return near.where(inside).select(
        *events.columns,
        begin["at"].alias("batch_start"),
        finish["at"].alias("batch_end"),
        finish["eid"].alias("batch_eid"),
        begin["total"].alias("batch_students"),
        F.when(of_batch, F.col("_read.idx")).alias("student_idx"),
        F.when(of_batch, F.col("_read.num")).alias("student_num"),
    )


NO_RUN = ("exam_id", "students_total", "student_idx", "student_num", "question", "question_type", "phase", "last_error")


def latest_state(events: DataFrame, by: Sequence[str] = ("source",), order: str = "line_no") -> DataFrame:
    """State of the run behind each log after its last line: what the events since the last start say.

    Two aggregates by log, combined before the shuffle: the place of the last start, then, of the events from there, the last value
    of every field. A log that never starts is taken from its first event.
    """
    by = list(by)
    began = events.groupBy(*by).agg(F.max(F.when(_is_start(), F.col(order))).alias("_began"), F.max(order).alias("last_line"))
    since = events.join(began, by).where(F.col("_began").isNull() | (F.col(order) >= F.col("_began")))
    stage = F.col("stage")
    steps, asks, ends = stage.isin("read", "grade", "done"), stage == "q", _is_end()

    def last(value: Column, when: Column) -> Column:
        return F.max_by(value, F.when(when, F.col(order)))

    phase = F.when(_is_start(), "batch").when(ends, "idle").when(stage.isin("q", "read", "grade", "done", "error", "save"), stage)
    failed = F.coalesce("msg", F.lit("student failed"))
    out = since.groupBy(*by, "_began", "last_line").agg(
        last(_is_start(), _is_start() | ends).alias("busy"),
        last(F.col("eid"), _is_start()).alias("exam_id"),
        last(F.col("sTotal"), _is_start() | (steps & F.col("sTotal").isNotNull())).alias("students_total"),
        last(F.when(~ends, F.col("sIdx")), ends | (steps & F.col("sIdx").isNotNull())).alias("student_idx"),
        last(F.when(~ends, F.col("sNum")), ends | (steps & F.col("sNum").isNotNull())).alias("student_num"),
        last(F.when(asks, F.col("qNum")), asks | steps | ends).alias("question"),
        last(F.when(asks, F.col("qType")), asks | steps | ends).alias("question_type"),
        last(phase, phase.isNotNull()).alias("phase"),
        last(failed, stage == "error").alias("last_error"),
    )
    finished = since.where((stage == "done") & F.col("sIdx").isNotNull()).select(*by, "sIdx").distinct()
    counted = finished.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("completed"))
    done = F.coalesce("completed", F.lit(0))
    open_now = F.when(F.coalesce("busy", F.lit(False)) & F.col("phase").isin("read", "q", "grade"), 1).otherwise(0)
    pending = F.when(F.col("students_total").isNotNull(), F.greatest(F.col("students_total") - done - open_now, F.lit(0)))
    return out.join(counted, by, "left").select(*by, "busy", *NO_RUN, "last_line", done.alias("completed"), pending.alias("pending"))


def batches(batched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per closed batch."""
    return batched.groupBy(*by, "batch_start", "batch_end", "batch_eid", "batch_students").agg(
        F.count(F.lit(1)).alias("lines")
    )


def latest_batches(
    batch_rows: DataFrame, slugs: Sequence[str], students: int = 10, keep: int = 3
) -> DataFrame:
    """The last ``keep`` batches of the given size in log order; a batch without
    an id takes the slug of its position."""
    newest = (
        batch_rows.where(F.col("batch_students") == students)
        .orderBy(F.col("batch_start").desc())
        .limit(keep)
    )
    # at most `keep` rows meet here
    numbered = newest.withColumn("position", F.row_number().over(Window.orderBy("batch_start")))
    slug = F.get(F.array(*[F.lit(s) for s in slugs]), F.col("position").cast("int") - 1)
    return numbered.where(F.col("position") <= len(slugs)).withColumn(
        "slug", F.coalesce(F.col("batch_eid"), slug)
    )


def student_stage_times(question_events: DataFrame, keys: Sequence[str], qtype="qType", ms="elapsedMs") -> DataFrame:
    """Reading and grading time of each student."""
    is_open = F.col(qtype) == "open_ended"
    return question_events.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(is_open, F.lit(0)).otherwise(F.col(ms))), F.lit(0)).cast("bigint").alias("ocr_ms"),
        F.coalesce(F.sum(F.when(is_open, F.col(ms)).otherwise(F.lit(0))), F.lit(0)).cast("bigint").alias("ai_ms"),
        F.bool_or(is_open).alias("had_ai"),
    )


def time_by_type(events: DataFrame, keys: Sequence[str] = ("qType",), ms: str = "elapsedMs") -> DataFrame:
    """n, mean, upper median (sorted[n // 2]) and maximum per question type, from counts of whole milliseconds."""
    upper = {"median_ms": lambda n: F.floor(n / 2) + 1}
    return order_statistics(events, ms, upper, keys, bits=10).select(
        *keys,
        "n",
        round_half_up(F.col("total") / F.col("n"), 1).alias("avg_ms"),
        F.col("median_ms").cast("bigint").alias("median_ms"),
        F.col("highest").cast("bigint").alias("max_ms"),
    )


def batch_totals(batched: DataFrame, keys: Sequence[str] = ("batch_start", "batch_eid")) -> DataFrame:
    """Students, reading and grading time of every batch."""
    done = (F.col("stage") == "done") & F.col("ocrMs").isNotNull() & F.col("aiMs").isNotNull()
    total = F.col("total_ocr_ms") + F.col("total_ai_ms")
    return (
        batched.groupBy(*keys)
        .agg(
            F.count_if(done).alias("students"),
            F.coalesce(F.sum(F.when(done, F.col("ocrMs"))), F.lit(0)).cast("bigint").alias("total_ocr_ms"),
            F.coalesce(F.sum(F.when(done, F.col("aiMs"))), F.lit(0)).cast("bigint").alias("total_ai_ms"),
        )
        .select(
            "*",
            total.alias("total_ms"),
            (total / F.greatest(F.col("students"), F.lit(1)) / 1000).alias("avg_per_student_s"),
        )
    )


def global_times(batched: DataFrame) -> DataFrame:
    """Mean reading and grading time over all finished students, 0 when there are none."""
    done = (F.col("stage") == "done") & F.col("ocrMs").isNotNull() & F.col("aiMs").isNotNull()
    return batched.where(done).agg(
        F.count(F.lit(1)).alias("students"),
        F.coalesce(round_half_up(F.sum("ocrMs") / F.count(F.lit(1)), 1), F.lit(0.0)).alias("avg_ocr_ms"),
        F.coalesce(round_half_up(F.sum("aiMs") / F.count(F.lit(1)), 1), F.lit(0.0)).alias("avg_ai_ms"),
    )
