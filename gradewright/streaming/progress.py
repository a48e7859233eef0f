"""Live progress from stage events, and change feeds as streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradewright.functions.text import STAGE_TAG
from gradewright.operators.stages import stage_events, with_stage_fields
from gradewright.session import shared_folder


def batch_progress(lines: DataFrame, source: str = "source") -> DataFrame:
    """Running counters per log (one run per file): finished students, total,
    errors, reading and grading time. For update mode; the same on a batch."""
    ev = stage_events(lines)
    done = F.coalesce(F.col("stage") == "done", F.lit(False))
    return ev.groupBy(source).agg(
        F.max("eid").alias("exam_id"),
        F.max("sTotal").alias("students_total"),
        F.count_if(done).alias("students_done"),
        F.count_if(F.coalesce(F.col("stage") == "error", F.lit(False))).alias("errors"),
        F.coalesce(F.sum(F.when(done, F.col("ocrMs"))), F.lit(0)).cast("bigint").alias("ocr_ms"),
        F.coalesce(F.sum(F.when(done, F.col("aiMs"))), F.lit(0)).cast("bigint").alias("ai_ms"),
    )


def type_times(lines: DataFrame, approximate: bool = True) -> DataFrame:
    """Running time statistics per question type; the median is a sketch here, the
    exact one belongs to the batch report."""
    ev = stage_events(lines).where((F.col("stage") == "q") & F.col("elapsedMs").isNotNull())
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.sum("elapsedMs").alias("total_ms"),
        F.max("elapsedMs").alias("max_ms"),
    ]
    if approximate:
        measures.append(F.approx_percentile("elapsedMs", 0.5).alias("median_ms"))
    return ev.groupBy("qType").agg(*measures)


STATE = (
    "busy boolean, exam_id string, students_total int, student_idx int, student_num string, question string, "
    "question_type string, phase string, last_error string, last_event timestamp, last_line bigint"
)
OUTPUT = f"source string, {STATE}, completed int, pending int"
_FIELDS = [f.strip().split(" ")[0] for f in STATE.split(",")]
_COMPLETED = "student_idx int, student_num string, had_ai boolean, ocr_ms bigint, ai_ms bigint, finished_at timestamp"
_EVENT = ("stage", "state", "eid", "sIdx", "sTotal", "sNum", "qNum", "qType", "hadAi", "ocrMs", "aiMs", "msg")
CHANGE = "source string, piece bigint, block bigint, lines bigint, seq bigint, line_no bigint, last_event timestamp, change string"


def _plain(value):
    """A cell as a Python value; None for what is missing."""
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


def change_of(ev: pd.DataFrame) -> dict:
    """What ordered events of one log do to its state: ``reset`` (a run starts in them, and what came before is void), the fields that
    they ``set`` after it, and the students that they finish (``done``). Columns at a time, not event by event."""
    stage, state = ev["stage"].to_numpy(object), ev["state"].to_numpy(object)
    starts = ((stage == "batch") & (state == "start")).nonzero()[0]
    out: dict = {"reset": bool(len(starts)), "set": {}, "done": []}
    if len(starts):
        first = ev.iloc[starts[-1]]
        total = _plain(first["sTotal"])
        out["set"] = dict.fromkeys(_FIELDS[1:9]) | {"busy": True, "phase": "batch", "exam_id": _plain(first["eid"]), "students_total": total if total is None else int(total)}
        ev, stage, state = ev.iloc[starts[-1] + 1 :], stage[starts[-1] + 1 :], state[starts[-1] + 1 :]
    ends = (stage == "batch") & (state == "end")
    steps = (stage == "read") | (stage == "grade") | (stage == "done")
    asks, fails = stage == "q", stage == "error"

    def last(mask, *fields):
        """The named cells of the last event of a kind; nothing when there is none."""
        at = mask.nonzero()[0]
        return [_plain(ev[f].iloc[at[-1]]) for f in fields] if len(at) else None

    def put(found, *names, whole=False):
        if found is not None:
            out["set"].update(zip(names, [int(v) if whole and v is not None else v for v in found], strict=True))

    def known(name):
        return steps & ev[name].notna().to_numpy()

    phased = ends | steps | asks | fails | (stage == "save")
    if (found := last(phased, "stage")) is not None:
        out["set"]["phase"] = "idle" if found[0] == "batch" else found[0]
    if ends.any():
        out["set"]["busy"] = False
    if (found := last(asks | steps | ends, "stage", "qNum", "qType")) is not None:
        put(found[1:] if found[0] == "q" else [None, None], "question", "question_type")
    for name, field, whole in (("student_idx", "sIdx", True), ("student_num", "sNum", False)):
        if (found := last(ends | known(field), "stage", field)) is not None:
            put([None if found[0] == "batch" else found[1]], name, whole=whole)
    put(last(known("sTotal"), "sTotal"), "students_total", whole=True)
    if (found := last(fails, "msg")) is not None:
        out["set"]["last_error"] = found[0] if found[0] is not None else "student failed"
    done = ev[(stage == "done") & ev["sIdx"].notna().to_numpy()].drop_duplicates("sIdx", keep="last")
    for row in done[["sIdx", "sNum", "hadAi", "ocrMs", "aiMs", "ingest_ts"]].itertuples(index=False):
        idx, num, ai, ocr_ms, ai_ms, ts = map(_plain, row)
        out["done"].append([int(idx), num, None if ai is None else bool(ai), None if ocr_ms is None else int(ocr_ms), None if ai_ms is None else int(ai_ms), ts.isoformat()])
    return out


def then(first: dict, second: dict) -> dict:
    """One change after another."""
    if second["reset"]:
        return second
    finished = {d[0]: d for d in [*first["done"], *second["done"]]}
    return {"reset": first["reset"], "set": {**first["set"], **second["set"]}, "done": list(finished.values())}


def _changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The events of every split folded into one change, in the order of the split's lines."""
    key, now = None, None

    def row() -> pd.DataFrame:
        change = None if now["change"] is None else json.dumps(now["change"])
        return pd.DataFrame([(*key, now["lines"], now["seq"], now["line_no"], now["ts"], change)], columns=[c.split(" ")[0] for c in CHANGE.split(", ")])

    for pdf in batches:
        keys = list(zip(pdf["source"], pdf["piece"], pdf["block"], strict=True))
        start = 0
        while start < len(keys):
            if keys[start] != key:
                if key is not None:
                    yield row()
                key, now = keys[start], {"change": None, "lines": None, "seq": None, "line_no": None, "ts": None}
            end = start + 1
            while end < len(keys) and keys[end] == key:
                end += 1
            part = pdf.iloc[start:end]
            counted = part["block_lines"].dropna()
            if len(counted):
                now["lines"] = int(counted.iloc[-1])
            ev = part[part["stage"].notna()]
            if len(ev):
                change = change_of(ev)
                now["change"] = change if now["change"] is None else then(now["change"], change)
                now["seq"], now["line_no"], now["ts"] = _plain(ev["seq"].iloc[-1]), _plain(ev["line_no"].iloc[-1]), ev["ingest_ts"].iloc[-1]
            start = end
    if key is not None:
        yield row()


class BatchState(StatefulProcessor):
    """Latest state of the run behind each log, plus its finished students.

    What arrives is one change for each split of a log, already folded where the split was read. State is one row, the number of the next line of
    the log, and one map entry per finished student of the open run; a new run clears the last. Events carry no run id, so the log is the key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", f"{STATE}, next_line bigint, completed int")
        self.completed = handle.getMapState("completed", "student_idx int", _COMPLETED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        names = [*_FIELDS, "next_line", "completed"]
        now = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names) | {"next_line": 0, "completed": 0}
        # one row per split of the trigger's files of this log
        for block in pd.concat(list(rows)).sort_values(["piece", "block"]).itertuples(index=False):
            if block.change is not None:
                self._apply(now, json.loads(block.change))
                given = _plain(block.line_no)
                now["last_line"] = int(given) if given is not None else now["next_line"] + int(block.seq)
                now["last_event"] = block.last_event
            now["next_line"] += int(_plain(block.lines) or 0)
        self.state.update(tuple(now[n] for n in names))
        total = now["students_total"]
        open_now = 1 if now["busy"] and now["phase"] in ("read", "q", "grade") else 0
        row = {"source": key[0], **{f: now[f] for f in _FIELDS}, "completed": now["completed"]}
        row["pending"] = max(total - now["completed"] - open_now, 0) if total is not None else None
        yield pd.DataFrame([row])

    def _apply(self, now: dict, change: dict) -> None:
        if change["reset"]:
            now["completed"] = 0
            if self.completed.exists():
                self.completed.clear()
        now.update(change["set"])
        for idx, num, ai, ocr_ms, ai_ms, ts in change["done"]:
            now["completed"] += not self.completed.containsKey((idx,))
            self.completed.updateValue((idx,), (idx, num, ai, ocr_ms, ai_ms, pd.Timestamp(ts)))

    def close(self) -> None:
        pass


def state_changes(lines: DataFrame) -> DataFrame:
    """One change per split of ``stream_stage_log``, or per line where lines bring their own ``line_no``."""
    if "line_no" in lines.columns:
        one = F.lit(None).cast("bigint")
        lines = lines.select("source", F.lit(0).cast("bigint").alias("piece"), F.col("line_no").alias("block"), one.alias("seq"), one.alias("block_lines"), "ingest_ts", "line", "line_no")
        lines = lines.where(F.contains("line", F.lit(STAGE_TAG)))
    else:
        lines = lines.withColumn("line_no", F.lit(None).cast("bigint"))
    ev = with_stage_fields(lines).select("source", "piece", "block", "seq", "block_lines", "line_no", "ingest_ts", *_EVENT)
    return ev.mapInPandas(_changes, CHANGE)


def batch_state(lines: DataFrame, mode: str = "update") -> DataFrame:
    """Latest state of every log from ``stream_stage_log``, or from a stream with source, line_no, ingest_ts and line. Lines are
    folded split by split where they are read, so the keyed state takes one row per split, not per line. Pieces of a log must arrive in order."""
    return state_changes(lines).groupBy("source").transformWithStateInPandas(
        statefulProcessor=BatchState(), outputStructType=OUTPUT, outputMode=mode, timeMode="none"
    )


def student_buckets(state: DataFrame) -> DataFrame:
    """One row per student of a run: done, current or pending."""
    rows = state.where(F.col("students_total") > 0).select(
        "source", "completed", "student_idx", "busy",
        F.explode(F.sequence(F.lit(0), F.col("students_total") - 1)).alias("idx"),
    )
    bucket = (
        F.when(F.col("idx") < F.col("completed"), "done")
        .when(F.col("busy") & (F.col("idx") == F.coalesce("student_idx", F.lit(-1))), "current")
        .otherwise("pending")
    )
    return rows.select("source", "idx", bucket.alias("bucket"))


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed states need, for the streams started inside."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def settled(stream: DataFrame, keys: Sequence[str], name: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now, and give its last row for each key. Triggers are written one folder each, so a repeated one
    overwrites itself; the folders, and the stream's checkpoint, are in the shared folder."""
    root = shared_folder(stream.sparkSession, f"{name}-{uuid.uuid4().hex}")

    def write(rows: DataFrame, trigger: int) -> None:
        rows.withColumn("trigger", F.lit(trigger)).write.mode("overwrite").parquet(f"{root}/out/run={trigger}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("trigger", T.IntegerType())])
    rows = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/out")
    last = rows.groupBy(*keys).agg(F.max("trigger").alias("trigger"))
    return rows.join(last, [*keys, "trigger"]).drop("trigger")


def apply_feed(
    feed: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
    available_now: bool = True,
):
    """Run the batch change operators on every micro-batch of a change feed.

    ``write(changes, batch_id)`` appends to the change and audit tables and rebuilds
    the views; it must be idempotent per batch id, for a batch may be repeated.
    Without ``checkpoint`` the cluster's shared folder is used.
    """
    checkpoint = checkpoint or shared_folder(feed.sparkSession, "change_feed")
    writer = feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
