import json
import os
import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradewright.operators import stages
from gradewright.operators.stages import stage_events, time_by_type
from gradewright.settings import Thresholds
from gradewright.sources.logs import read_stage_log, stream_stage_log
from gradewright.streaming import progress
from gradewright.streaming.requests import dedupe_stream

RUN = [
    "[STAGE] stage=batch state=start eid=E1 sTotal=3",
    "[STAGE] sIdx=0 sTotal=3 stage=read",
    "[STAGE] sIdx=0 sTotal=3 sNum=n0 stage=read",
    "[STAGE] stage=q qNum=1 qType=matching elapsedMs=40",
    "[STAGE] sIdx=0 sTotal=3 sNum=n0 stage=done hadAi=0 ocrMs=40 aiMs=5",
    "[STAGE] sIdx=1 sTotal=3 stage=error",
    "noise",
    "[STAGE] sIdx=2 sTotal=3 sNum=n2 stage=read",
    "[STAGE] stage=q qNum=4 qType=open_ended elapsedMs=90",
]


def run_stream(df, tmp_path, mode, name="out"):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_progress_stream_equals_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, lines in (("a", RUN), ("b", RUN[:5])):
        (logs / f"{name}.log").write_text("\n".join(lines))
    live = run_stream(progress.batch_progress(stream_stage_log(spark, str(logs), 1)), tmp_path, "complete", "live")
    batch = progress.batch_progress(spark.read.text(str(logs)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source")))
    assert rows(live) == rows(batch)
    assert rows(live, "students_done", "errors", "ocr_ms", "ai_ms") == [(1, 0, 40, 5), (1, 1, 40, 5)]


def numbered(spark, tmp_path, chunks):
    d = tmp_path / "in"
    d.mkdir()
    n = 0
    for i, chunk in enumerate(chunks):
        out = []
        for line in chunk:
            out.append(json.dumps({"source": "log", "line_no": n, "ingest_ts": f"2026-01-01T00:00:{n:02d}", "line": line}))
            n += 1
        file = d / f"{i:03d}.json"
        file.write_text("\n".join(out))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)  # files are taken in time order
    return (
        spark.readStream.schema("source string, line_no long, ingest_ts timestamp, line string")
        .option("maxFilesPerTrigger", 1).json(str(d))
    )


def test_type_times_stream(spark, tmp_path):
    src = numbered(spark, tmp_path, [RUN[:4], RUN[4:]])
    live = run_stream(progress.type_times(src), tmp_path, "complete", "types")
    assert rows(live, "qType", "n", "max_ms", "median_ms") == [("matching", 1, 40, 40), ("open_ended", 1, 90, 90)]
    exact = time_by_type(stage_events(spark.createDataFrame([(x,) for x in RUN], "line string")).where("stage = 'q'"))
    assert rows(exact, "qType", "median_ms") == rows(live, "qType", "median_ms")


def test_latest_state(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = numbered(spark, tmp_path, [RUN[:4], RUN[4:], ["[STAGE] stage=batch state=end eid=E1 sTotal=3"]])
        got = run_stream(progress.batch_state(src), tmp_path, "update", "state").orderBy("last_line").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    a, b, c = got
    assert (a.busy, a.exam_id, a.student_idx, a.student_num, a.question, a.phase, a.completed, a.pending) == (True, "E1", 0, "n0", "1", "q", 0, 2)
    assert (b.student_idx, b.question_type, b.last_error, b.completed, b.pending) == (2, "open_ended", "student failed", 1, 1)
    assert (c.busy, c.phase, c.completed, c.student_idx) == (False, "idle", 1, None)
    state = spark.createDataFrame([("log", 1, 2, True, 3)], "source string, completed int, student_idx int, busy boolean, students_total int")
    assert rows(progress.student_buckets(state), "idx", "bucket") == [(0, "done"), (1, "pending"), (2, "current")]


NAMES = ("busy", "exam_id", "students_total", "student_idx", "student_num", "question", "question_type", "phase", "last_error", "last_line", "completed", "pending")


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def random_run(r):
    """A log with several runs, noise, errors, repeated students and missing fields."""
    out = []
    for _ in range(r.randint(1, 3)):
        out.append(r.choice(["[STAGE] stage=batch state=start eid=E1 sTotal=4", "[STAGE] stage=batch state=start", "noise"]))
        for _ in range(r.randint(0, 25)):
            i = r.randrange(4)
            out.append(r.choice([
                f"[STAGE] sIdx={i} sTotal=4 sNum=n{i} stage=read", f"[STAGE] sIdx={i} stage=grade", "[STAGE] stage=read sNum=x", "noise", "",
                f"[STAGE] stage=q qNum={i} qType=matching elapsedMs=4", "[STAGE] stage=q", f"[STAGE] sIdx={i} stage=done hadAi=1 ocrMs=4 aiMs=5",
                "[STAGE] stage=error msg=it broke twice", "[STAGE] stage=error", "[STAGE] stage=save", "[STAGE] stage=batch state=odd",
            ]))
        out += r.choice([["[STAGE] stage=batch state=end eid=E1 sTotal=4"], []])
    return out


def write_pieces(folder, name, pieces, start=0):
    for i, lines in enumerate(pieces, start):
        file = folder / f"{name}.{i}"
        file.write_text("".join(f"{x}\n" for x in lines))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)


def cut(lines, r, n):
    at = sorted(r.randrange(len(lines) + 1) for _ in range(n - 1))
    return [lines[a:b] for a, b in zip([0, *at], [*at, len(lines)], strict=True)]


def test_state_of_followed_logs_equals_batch_after_a_restart(spark, tmp_path, rocks):
    """Three triggers, then a restart from the checkpoint with more pieces; split files and odd numbers of lines."""
    r = random.Random(2)
    logs = {f"log{k}": cut(random_run(r), r, 5) for k in range(12)}
    folder = tmp_path / "logs"
    folder.mkdir()
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")

    def follow():
        q = (
            progress.batch_state(stream_stage_log(spark, str(folder), max_files=12))
            .writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .foreachBatch(lambda df, i: df.withColumn("trigger", F.lit(i)).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={i}")).start()
        )
        q.awaitTermination(300)

    def compare(upto):
        batch = stages.latest_state(stages.stage_events(read_stage_log(spark, str(folder)).withColumn("ingest_ts", F.lit(None).cast("timestamp"))))
        want = {x.source: tuple(x[n] for n in NAMES) for x in batch.collect()}
        live = spark.read.parquet(f"{tmp_path}/out").where("last_line IS NOT NULL").orderBy("trigger").collect()
        got = {x.source: tuple(x[n] for n in NAMES) for x in live}
        assert got == want and len(got) > 8
        assert max(x.trigger for x in live) >= upto

    try:
        for name, pieces in logs.items():
            write_pieces(folder, name, pieces[:3])
        follow()
        compare(2)
        for name, pieces in logs.items():
            write_pieces(folder, name, pieces[3:], 3)
        follow()
        compare(4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_logs_are_taken_together(spark, tmp_path):
    """Triggers are filled by bytes, so their number does not grow with the number of logs."""
    folder = tmp_path / "logs"
    folder.mkdir()
    write_pieces(folder, "log", [RUN] * 20)

    def triggers(name, **limit):
        q = stream_stage_log(spark, str(folder), **limit).writeStream.format("noop").option("checkpointLocation", str(tmp_path / name))
        q = q.trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sum(p["numInputRows"] > 0 for p in q.recentProgress)

    assert triggers("whole") == 1
    assert 1 < triggers("cut", max_bytes=5 * sum(len(x) + 1 for x in RUN)) < 8


def test_split_files_keep_their_line_numbers(spark, tmp_path):
    lines = [f"[STAGE] stage=q qNum={i}" + "x" * (i % 60) for i in range(400)]
    write_pieces(tmp_path, "a.log", [lines[:250], lines[250:]], 9)  # 9 and 10: by number, not by name
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = read_stage_log(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        assert rows(got, "line_no", "line") == sorted(((i, x) for i, x in enumerate(lines)), key=str)
        assert got.select("source").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_changes_compose(spark):
    """Folding a log in parts equals folding it whole."""
    r = random.Random(7)
    for _ in range(60):
        run = [x for x in random_run(r) if "[STAGE]" in x]
        if not run:
            continue
        df = stages.stage_events(spark.createDataFrame([(i, x) for i, x in enumerate(run)], "i long, line string").withColumn("ingest_ts", F.timestamp_seconds("i"))) if _ == 0 else None
        ev = parsed(run)
        if df is not None:
            fields = ["stage", "sIdx", "qNum", "msg"]
            plain = df.orderBy("i").select(*fields).toPandas()
            assert [[progress._plain(v) for v in row] for row in plain.to_numpy(object)] == [[progress._plain(v) for v in row] for row in ev[fields].to_numpy(object)]
        at = r.randrange(len(run) + 1)
        parts = [progress.change_of(p) for p in (ev.iloc[:at], ev.iloc[at:])]
        whole, joined = progress.change_of(ev), progress.then(*parts)
        assert (joined["reset"], joined["set"], sorted(joined["done"])) == (whole["reset"], whole["set"], sorted(whole["done"]))


def parsed(run):
    out = []
    for i, line in enumerate(run):
        head, _, msg = line.partition("msg=")
        f = dict(x.split("=", 1) for x in head.split() if "=" in x)
        ints = {k: int(f[k]) if k in f else None for k in ("sIdx", "sTotal", "hadAi", "ocrMs", "aiMs")}
        out.append({k: f.get(k) for k in ("stage", "state", "eid", "sNum", "qNum", "qType")} | ints | {"msg": msg or None, "ingest_ts": pd.Timestamp(i, unit="s")})
    return pd.DataFrame(out)


def test_request_stream_drops_repeats(spark, tmp_path):
    d = tmp_path / "req"
    d.mkdir()
    (d / "0.json").write_text("\n".join(json.dumps({"fingerprint": f, "ts": f"2026-01-01T00:00:{s:02d}"}) for f, s in (("a", 1), ("a", 9), ("b", 3))))
    src = spark.readStream.schema("fingerprint string, ts timestamp").json(str(d))
    live = run_stream(dedupe_stream(src, cfg=Thresholds()), tmp_path, "append", "req")
    assert sorted(r.fingerprint for r in live.collect()) == ["a", "b"]


def test_change_feed(spark, tmp_path):
    d, out = tmp_path / "feed", str(tmp_path / "changes")
    d.mkdir()
    for i in range(2):
        (d / f"{i}.json").write_text(json.dumps({"change_id": i, "k": "q", "new_score": i + 0.5}))
    feed = spark.readStream.schema("change_id long, k string, new_score double").option("maxFilesPerTrigger", 1).json(str(d))

    def write(df, batch_id):
        # one directory per batch id: a repeated batch overwrites itself
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    progress.apply_feed(feed, write, str(tmp_path / "cp")).awaitTermination(120)
    assert rows(spark.read.parquet(out), "change_id", "new_score") == [(0, 0.5), (1, 1.5)]
