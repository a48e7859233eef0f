import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradewright.operators import cohort, requests, series, stages
from gradewright.operators.running import Measure, order_statistics, row_numbers, running, segments, surrogate_ids
from gradewright.plans import queries
from gradewright.settings import Thresholds


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_running_equals_a_loop(spark, bits):
    rng = random.Random(bits)
    data = []
    for g in ("a", "b"):
        for i in sorted(rng.sample(range(60), 25)):
            data.append((g, i, rng.randint(-3, 3), rng.choice([None, None, f"v{i}"])))
    df = spark.createDataFrame(data, "g string, i int, x int, v string")
    got = running(
        df, "i",
        [
            Measure("s", "sum", F.col("x")),
            Measure("before", "last", F.col("v"), inclusive=False),
            Measure("after", "last", F.col("v"), inclusive=False, backward=True),
            Measure("upto", "last", F.col("v")),
        ],
        ["g"], bits,
    )
    want = []
    for g, i, x, v in data:
        mine = [r for r in data if r[0] == g]
        past = [r for r in mine if r[1] < i and r[3]]
        future = [r for r in mine if r[1] > i and r[3]]
        upto = [r for r in mine if r[1] <= i and r[3]]
        want.append((
            g, i, sum(r[2] for r in mine if r[1] <= i), past[-1][3] if past else None,
            future[0][3] if future else None, upto[-1][3] if upto else None,
        ))
    assert rows(got, "g", "i", "s", "before", "after", "upto") == sorted(want, key=str)


def test_row_numbers_and_surrogates(spark):
    df = spark.range(0, 500, 7).withColumn("g", F.col("id") % 2)
    got = rows(row_numbers(df, "id", "n", ["g"], bits=3), "g", "id", "n")
    seen = {}
    for g, i, n in sorted(got):
        seen[g] = seen.get(g, 0) + 1
        assert n == seen[g]
    ids = surrogate_ids(df.select(F.col("id").cast("string").alias("k")), "k", "n", 10)
    assert sorted(r[0] for r in ids.select("n").collect()) == list(range(11, 11 + df.count()))


def log(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")


S, E = "[STAGE] stage=batch state=start sTotal=2", "[STAGE] stage=batch state=end eid=X sTotal=2"
READ, Q = "[STAGE] sIdx={} sTotal=2 sNum=n{} stage=read", "[STAGE] stage=q qNum=1 qType=matching elapsedMs={}"
DONE = "[STAGE] sIdx={} sTotal=2 sNum=n{} stage=done hadAi=0 ocrMs={} aiMs={}"


def test_brackets(spark):
    x = Q.format(5)
    ev = stages.stage_events(log(spark, [x, S, x, S, Q.format(7), "noise", E, Q.format(9), E, S, x]))
    got = stages.bracket_batches(ev)
    assert rows(got, "line_no", "batch_start", "batch_end", "batch_eid") == [(3, 3, 6, "X"), (4, 3, 6, "X"), (6, 3, 6, "X")]


def loop_brackets(kinds):
    out, cur = [], None
    for i, k in enumerate(kinds):
        if k == "s":
            cur = [i]
        elif k == "e":
            if cur is not None:
                out += [(j, cur[0]) for j in [*cur, i]]
                cur = None
        elif cur is not None:
            cur.append(i)
    return out


def test_random_brackets_equal_the_loop(spark):
    rng = random.Random(3)
    for _ in range(4):
        kinds = rng.choices("sexxx", k=200)
        lines = [{"s": S, "e": E, "x": Q.format(1)}[k] for k in kinds]
        got = stages.bracket_batches(stages.stage_events(log(spark, lines)))
        assert sorted(map(tuple, got.select("line_no", "batch_start").collect())) == sorted(loop_brackets(kinds))


def test_students_times_and_totals(spark):
    lines = [
        S, Q.format(1), READ.format(0, 0), Q.format(10), Q.format(20), DONE.format(0, 0, 30, 70), READ.format(1, 1),
        "[STAGE] stage=q qNum=2 qType=open_ended elapsedMs=400", DONE.format(1, 1, 0, 400), E,
    ]
    ev = stages.bracket_batches(stages.stage_events(log(spark, lines)))
    q = ev.where("stage = 'q'")
    assert rows(q, "line_no", "student_idx", "student_num") == [(1, None, None), (3, 0, "n0"), (4, 0, "n0"), (7, 1, "n1")]
    times = stages.student_stage_times(q.where("student_idx is not null"), ["batch_start", "student_idx"])
    assert rows(times, "student_idx", "ocr_ms", "ai_ms", "had_ai") == [(0, 30, 0, False), (1, 0, 400, True)]
    (t,) = stages.batch_totals(ev).collect()
    assert (t.students, t.total_ms, t.avg_per_student_s) == (2, 500, 0.25)
    (g,) = stages.global_times(ev).collect()
    assert (g.avg_ocr_ms, g.avg_ai_ms) == (15.0, 235.0)
    (z,) = stages.global_times(ev.where("false")).collect()
    assert (z.students, z.avg_ocr_ms) == (0, 0.0)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 9)], "qType string, elapsedMs long")
    got = stages.time_by_type(df)
    assert rows(got, "qType", "n", "avg_ms", "median_ms", "max_ms") == [("a", 4, 2.5, 3, 4), ("b", 1, 9.0, 9, 9)]


def test_latest_batches(spark):
    b = spark.createDataFrame([(10, None, 10), (20, "E2", 10), (30, None, 9), (40, None, 10), (50, None, 10)],
        "batch_start long, batch_eid string, batch_students int").withColumn("batch_end", F.col("batch_start") + 1)
    got = stages.latest_batches(b, ["se", "calc", "phys"])
    assert rows(got, "batch_start", "slug") == [(20, "E2"), (40, "calc"), (50, "phys")]


def test_median_and_histogram(spark):
    df = spark.createDataFrame([("e", x) for x in (0.0, 9.99, 100.0, 50.0)] + [("f", 3.5)], "g string, pct double")
    assert rows(cohort.score_histogram(df, "pct"), "bin", "students") == [(0, 3), (5, 1), (9, 1)]
    got = {r.g: (round(r.mean, 4), r.median) for r in cohort.exact_median(df, "pct", ["g"]).collect()}
    assert got == {"e": (39.9975, 29.995), "f": (3.5, 3.5)}
    assert cohort.exact_median(df, "pct").first().median == 9.99
    rng = random.Random(2)
    xs = [rng.choice([1.5, 2.0, 2.25, 7.75, rng.random() * 90]) for _ in range(301)]
    many = spark.createDataFrame([(x,) for x in xs], "pct double")
    assert cohort.exact_median(many, "pct").first().median == sorted(xs)[150]


def test_islands(spark):
    high = set(range(10, 20)) | set(range(25, 40)) | set(range(60, 65)) | set(range(90, 101))
    df = spark.createDataFrame([(y, 9 if y in high else 0) for y in range(120)], "y int, v int")
    for bits in (2, 16):
        got = series.islands(df, "y", "v", 5, bits=bits, height=104)
        assert rows(got, "start", "end") == [(4, 46), (84, 104)]


def chain(times, failing, ttl):
    out, last = [], None
    for t in times:
        if last is None or t - last >= ttl:
            out.append(t)
            if t not in failing:
                last = t
    return out


@pytest.mark.parametrize("seed", range(3))
def test_request_reuse(spark, seed):
    """Dense and sparse keys, pauses, failures, exact distances, times before 1970, and no key at all."""
    rng = random.Random(seed)
    data, want = [], []
    for k, times in {
        "a": rng.sample(range(3000), 120), "b": rng.sample(range(3000), 600), "c": range(-900, 2400, 50), "d": range(0, 4000, 100),
        "e": rng.sample(range(100_000), 80), "f": [7], "g": [t * 99 for t in range(40)], None: rng.sample(range(800), 60),
    }.items():
        times = sorted(times)
        failing = set() if k in ("c", "f") else set(rng.sample(times, len(times) // (2 + seed * 3)))
        data += [(k, t, t in failing) for t in times for _ in range(rng.choice([1, 2]))]
        want += [(k, t) for t in chain(times, failing, 100)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "fingerprint string, t long, bad boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = requests.fresh_requests(df, failed="bad", cfg=Thresholds(request_ttl_seconds=100))
    assert rows(got, "fingerprint", F.unix_timestamp("ts")) == sorted(want, key=str)
    assert "MapInPandas" not in got._jdf.queryExecution().toString()


def test_request_reuse_ends(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "fingerprint string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert requests.fresh_requests(df, cfg=Thresholds(request_ttl_seconds=0)).count() == 2
    assert requests.fresh_requests(df.where("false")).count() == 0
    failed = df.withColumn("bad", F.lit(True))
    assert requests.fresh_requests(failed, failed="bad").count() == 2


def test_groups_without_a_key_and_negative_values(spark):
    data = [(g, i, x) for g, xs in ((None, [3, 1, 2]), ("a", [5])) for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "g string, i long, x long")
    got = running(df, "i", [Measure("s", "sum", F.col("x"))], ["g"], bits=1)
    assert rows(got, "g", "i", "s") == sorted([(None, 0, 3), (None, 1, 4), (None, 2, 6), ("a", 0, 5)], key=str)
    odd = segments(df, "i", F.col("x"), F.col("x"), lambda p, h: p.isNull() | (h < p), "n", ["g"], bits=1)
    assert rows(odd, "g", "i", "n") == sorted([(None, 0, 1), (None, 1, 2), (None, 2, 2), ("a", 0, 1)], key=str)
    rng = random.Random(4)
    values = [(g, rng.choice([-1.5, -0.0, 0.0, 1e-300, -1e300, rng.gauss(0, 1), rng.random() / 1e6])) for g in ["x", None] * 150]
    stats = order_statistics(spark.createDataFrame(values, "g string, v double"), "v", {"low": lambda n: n * 0 + 1, "mid": lambda n: F.floor(n / 2) + 1, "last": lambda n: n}, ["g"])
    want = {g: sorted(v for h, v in values if h == g) for g in ("x", None)}
    assert {r.g: (r.n, r.low, r.mid, r["last"], r.highest) for r in stats.collect()} == {g: (150, v[0], v[75], v[-1], v[-1]) for g, v in want.items()}


def planned(df):
    """Scans and shuffles of the plan as first made; what is reused counts once."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan"), len(re.findall(r"\n[^\n]*?[-+] Exchange ", text))


@pytest.mark.parametrize(("name", "scans", "shuffles"), [("islands", 1, 7), ("timing_by_type", 1, 6), ("latest_batches", 1, 6), ("score_median", 2, 6), ("export_rows", 1, 2)])
def test_inputs_are_computed_once(spark, name, scans, shuffles):
    """Of one table one scan; ``score_median`` reads two."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = planned(queries.REGISTRY[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got[0] <= scans and 0 < got[1] <= shuffles, got
