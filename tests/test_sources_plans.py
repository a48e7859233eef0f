import base64
import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradewright.operators import alignment, authoring, scoring
from gradewright.plans import adapters as src
from gradewright.plans import grading
from gradewright.sources import archetypes, exam_map, logs, results, scans

BOX = {"x": 1, "y": 2, "w": 3, "h": 4}
MAP = {
    "examId": "E1",
    "date": "2026-01-01",
    "totalPages": 2,
    "pages": [
        {
            "pageId": "P1_E1", "pageIndex": 0, "pageWidth": 100, "pageHeight": 200,
            "anchors": {"TL": {"type": "bullseye", "center": {"x": 5, "y": 6}, "diameter": 16}, "TR": {"x": 90, "y": 6}},
            "studentNumberBoxes": [BOX, {"x": 10, "y": 2, "w": 3, "h": 4}],
            "questions": {
                "1": {"type": "multiple_choice", "boundingBox": BOX, "scoring": {"points": 10, "penaltyPerItem": None},
                      "expectedAnswer": {"correctOption": "B"}, "options": {"A": BOX, "B": BOX}},
                "2": {"type": "multi_select", "scoring": {"points": 10}, "expectedAnswer": {"correctOptions": ["A", "C"]}},
                "5": {"type": "open_ended", "scoring": {"points": 1}, "expectedAnswer": {"text": "old"}},
            },
        },
        {
            "pageId": "P2_E1", "pageIndex": 1,
            "questions": {
                "3": {"type": "matching", "scoring": {"points": 10}, "expectedAnswer": {"correctMatches": {"1": "A", "2": "b"}},
                      "answerBoxes": {"1": BOX, "2": BOX}, "answerSection": BOX},
                "4": {"type": "fill_blanks", "scoring": {"points": 10, "penaltyPerItem": 1},
                      "expectedAnswer": {"correctBlanks": {"1": "agile", "2": "scrum"}}, "fillBlanks": {"1": BOX}},
                "5": {"type": "open_ended", "scoring": {"points": 10}, "expectedAnswer": {"text": "key"}, "solutionArea": BOX},
                "6": {"type": "essay", "scoring": {"points": 10}},
            },
        },
    ],
}


@pytest.fixture(scope="module")
def maps(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("maps") / "map.json"
    path.write_text(json.dumps(MAP, indent=1))
    return exam_map.read_exam_map(spark, str(path))


def test_question_dimension(maps):
    dim = exam_map.question_dimension(maps)
    assert rows(dim, "q_num", "q_type", "points", "penalty", "page_pos") == [
        ("1", "multiple_choice", 10.0, 0.0, 0), ("2", "multi_select", 10.0, 0.0, 0), ("3", "matching", 10.0, 0.0, 1),
        ("4", "fill_blanks", 10.0, 1.0, 1), ("5", "open_ended", 10.0, 0.0, 1), ("6", "essay", 10.0, 0.0, 1),
    ]
    assert rows(exam_map.letter_sets(dim), "q_num", F.array_sort("allowed")) == [("3", ["A", "B"])]
    want = dim.select("q_num", exam_map.expected_answer("q_type", "expected").alias("e")).where("q_num in ('1','4','5')")
    got = {r.q_num: r.e for r in want.collect()}
    assert got["1"].option == "B" and got["4"].blanks == {"1": "agile", "2": "scrum"} and got["5"].text == "key"
    assert got["1"].matches is None


def test_boxes_and_anchors(maps):
    kinds = {}
    for r in exam_map.box_dimension(maps).collect():
        kinds[r.kind] = kinds.get(r.kind, 0) + 1
    assert kinds == {"number_region": 1, "digit": 2, "question": 1, "option": 2, "solution": 1, "section": 1, "answer": 2, "blank": 1}
    region = exam_map.box_dimension(maps).where("kind = 'number_region'").first().box
    assert tuple(region) == (-3.0, -2.0, 20.0, 12.0)
    assert rows(exam_map.anchor_dimension(maps), "corner", "at.x", "at.y") == [("TL", 5.0, 6.0), ("TR", 90.0, 6.0)]


def test_grading_from_readings_to_results(spark, maps):
    dim = exam_map.question_dimension(maps)
    mk = spark.createDataFrame
    papers = mk([("E1", "s1", 0.9), ("E1", "s2", 0.7)], "exam_id string, student_number string, number_confidence double")
    ratios = mk(
        [("E1", "s1", "1", "A", 0, 0.02), ("E1", "s1", "1", "B", 1, 0.9), ("E1", "s1", "2", "A", 0, 0.9), ("E1", "s1", "2", "C", 2, 0.8),
         ("E1", "s2", "1", "A", 0, 0.9), ("E1", "s2", "1", "B", 1, 0.05), ("E1", "s2", "2", "A", 0, 0.1), ("E1", "s2", "2", "C", 2, 0.1)],
        "exam_id string, student_number string, q_num string, letter string, ord int, ratio double",
    )
    letters = mk(
        [("E1", "s1", "3", "1", 0, "cnn0", "A", 0.9), ("E1", "s1", "3", "2", 0, "cnn0", "B", 0.95), ("E1", "s1", "3", "2", 1, "ocr0", "D", 0.99),
         ("E1", "s2", "3", "1", 0, "cnn0", "B", 0.9)],
        "exam_id string, student_number string, q_num string, item string, ord int, reader string, text string, confidence double",
    )
    words = mk(
        [("E1", "s1", "4", "1", "aglie", 0.9, "", 0.0, "agile", 0.95, False), ("E1", "s1", "4", "2", "", 0.0, "", 0.0, "", 0.0, True)],
        "exam_id string, student_number string, q_num string, item string, first_text string, first_conf double, retry_text string,"
        "retry_conf double, third_text string, third_conf double, is_blank boolean",
    )
    verdicts = mk(
        [("E1", "s1", "5", ("3", False, False, False), "ok", False, None, "text")],
        "exam_id string, student_number string, q_num string, verdict struct<semantic_relevance_rating:string,missed_key_concepts:boolean,"
        "hallucination_detected:boolean,cheating_detected:boolean>, explanation string, failed boolean, crash string, wrote string",
    )
    graded = grading.grade(dim, grading.ReadInputs(papers, ratios, letters, words, verdicts))
    got = {(r.student_number, r.q_num): (r.score, r.status, r.needs_review) for r in graded.collect()}
    assert got == {
        ("s1", "1"): (10.0, "correct", False), ("s1", "2"): (10.0, "correct", False), ("s1", "3"): (10.0, "correct", False),
        ("s1", "4"): (5.0, "partial", False), ("s1", "5"): (5.0, "ai_graded", False), ("s1", "6"): (0.0, "error", True),
        ("s2", "1"): (0.0, "wrong", False), ("s2", "2"): (0.0, "blank", False), ("s2", "3"): (0.0, "wrong", False),
        ("s2", "4"): (0.0, "blank", True), ("s2", "5"): (0.0, "pending_review", True), ("s2", "6"): (0.0, "error", True),
    }
    assert rows(grading.results(papers, graded), "student_number", "total_score", "total_max_points") == [("s1", 40.0, 60.0), ("s2", 0.0, 60.0)]


def test_pages_of_students(spark, maps):
    pages = spark.createDataFrame([(1, 0, "P1_E1"), (1, 1, "P2_E1"), (1, 2, "P3_E1"), (1, 3, "P1_E1")], "batch_id long, page_idx int, qr_text string")
    batches = spark.createDataFrame([(1, "E1", 2)], "batch_id long, exam_id string, pages_per_exam int")
    got = grading.identify_pages(pages, batches, exam_map.map_pages(maps))
    assert rows(got, "student_idx", "page_idx", "page_id") == [(0, 0, "P1_E1"), (0, 1, "P2_E1"), (1, 3, "P1_E1")]


def test_expected_file(spark, tmp_path):
    doc = {"examId": "E", "students": [{"studentNumber": "1", "edgeCase": "tilt", "expectedTotalScore": 5, "expectedMaxPoints": 5,
        "expectedQuestions": {"1": {"type": "matching", "expectedScore": 5, "expectedMatches": {"1": "A"}}}}]}
    (tmp_path / "e.json").write_text(json.dumps(doc))
    r = results.read_expected(spark, str(tmp_path / "e.json"), multi_line=True).first()
    assert (r.student_number, r.edge_case, r.expected_total, r.q_num, r.expected.expectedMatches) == ("1", "tilt", 5.0, "1", {"1": "A"})


def test_stage_log_files_keep_line_order(spark, tmp_path):
    for name in "ab":
        lines = [f"[STAGE] stage=q qNum={i} qType=x elapsedMs={i}" if i % 3 else f"noise {i}" for i in range(4000)]
        (tmp_path / f"{name}.log").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # many splits per file
    try:
        df = logs.read_stage_log(spark, str(tmp_path))
        got = df.select("source", "line_no", F.regexp_extract("line", r"qNum=(\d+)", 1).cast("int").alias("q")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 2 * sum(1 for i in range(4000) if i % 3)
    assert all(r.line_no == r.q for r in got)


def test_dark_shares_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    data, want = [], {}
    for p in range(4):
        h, w, ch = 40, 50, (3 if p % 2 else 1)
        img = rng.integers(0, 256, (h, w, ch), dtype=np.uint8)
        boxes = [("a", 2.5, 3.0, 20.0, 15.0), ("t", 45.0, 1.0, 5.0, 6.0), ("out", 48.0, 38.0, 30.0, 30.0), ("neg", -5.0, -5.0, 12.0, 12.0)]
        grey = img[:, :, 0].astype(int) if ch == 1 else np.rint(img.astype(np.float32) @ np.array([0.114, 0.587, 0.299], np.float32)).astype(int)
        for k, x, y, bw, bh in boxes:
            x, y, bw, bh = (int(round(v)) for v in (x, y, bw, bh))
            if bw - 6 > 0 and bh - 6 > 0:
                x, y, bw, bh = x + 3, y + 3, bw - 6, bh - 6
            x, y = max(0, min(x, w - 1)), max(0, min(y, h - 1))
            bw, bh = min(bw, w - x), min(bh, h - y)
            dark = sum(1 for r in range(y, y + bh) for c in range(x, x + bw) if grey[r, c] <= 140)
            want[(p, k)] = dark / (bw * bh)
        data.append((p, h, w, ch, img.tobytes(), [dict(zip(("key", "x", "y", "w", "h"), b)) for b in boxes]))
    df = spark.createDataFrame(data, "page int, height int, width int, channels int, data binary, boxes array<struct<key:string,x:double,y:double,w:double,h:double>>")
    got = {(r.page, r.key): r.ratio for r in scans.dark_shares(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scan_files(spark, tmp_path):
    png = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")
    for i in (1, 12):
        (tmp_path / f"batch7_{i}.png").write_bytes(png)
    assert rows(scans.read_scans(spark, str(tmp_path)), "batch_name", "page_idx", "height", "width") == [("batch7", 1, 1, 1), ("batch7", 12, 1, 1)]


def test_perspective_maps_corners(spark):
    ref = {"TL": (10.0, 10.0), "TR": (90.0, 12.0), "BL": (11.0, 180.0), "BR": (92.0, 185.0)}
    found = {"TL": (21.0, 33.0), "TR": (205.0, 40.0), "BL": (30.0, 390.0), "BR": (190.0, 400.0)}
    anchors = spark.createDataFrame(
        [(p, c, *xy) for p in (1, 2, 3) for c, xy in found.items() if not (p == 2 and c == "BR") and not (p == 3 and c in ("TL", "BR"))],
        "page int, corner string, x double, y double",
    )
    pages = spark.createDataFrame([(p, *ref.values(), 100, 200, 200, 400) for p in (1, 2, 3, 4)],
        "page int, " + ", ".join(f"{c} struct<x:double,y:double>" for c in ref) + ", page_width int, page_height int, scan_width int, scan_height int")
    t = alignment.page_transforms(alignment.choose_tier(alignment.corner_columns(anchors, ["page"])), pages, ["page"])
    assert rows(alignment.transform_report(t, ["page"]), "page", "transform_mode", "anchors_detected", "scale_x") == [
        (1, "homography", 4, 2.0), (2, "homography", 3, 2.0), (3, "scale", 2, 2.0), (4, "scale", 0, 2.0),
    ]
    box = spark.createDataFrame([(p, (*ref["TL"], 82.0, 175.0)) for p in (1, 2, 3)], "page int, box struct<x:double,y:double,w:double,h:double>")
    got = rows(alignment.map_boxes(box, t, ["page"]), "page", "scan_box")
    assert [tuple(r[1]) for r in got] == [(21, 33, 190, 400), (21, 33, 214, 397), (20, 20, 184, 370)]


def test_archetypes(spark):
    key = spark.createDataFrame(
        [("1", "multiple_choice", "D", None, None, None), ("2", "matching", None, None, {"1": "A", "2": "B", "3": "C"}, None), ("3", "fill_blanks", None, None, {"1": "agile", "2": "xy"}, None)],
        "q_num string, q_type string, correct_option string, correct_options array<string>, correct_cells map<string,string>, correct_text string",
    )
    got = archetypes.derive_answers(key).collect()
    assert len(got) == 9
    assert {r.q_num: (r.answer.pick, r.answer.cells) for r in got if r.archetype == "A"} == {
        "1": ("D", None), "2": (None, {"1": "A", "2": "B", "3": "C"}), "3": (None, {"1": "agile", "2": "xy"}),
    }
    big = key.crossJoin(spark.range(300)).withColumn("q_num", F.col("id").cast("string")).where("q_type = 'multiple_choice'")
    share = archetypes.derive_answers(big).groupBy("archetype").agg(F.avg(F.when(F.col("treatment") == "right", 1.0).otherwise(0.0)).alias("r"))
    share = {r.archetype: r.r for r in share.collect()}
    assert share["A"] == 1.0 and 0.6 < share["B"] < 0.8 and 0.2 < share["C"] < 0.4


def test_authoring_round_trip(spark, maps):
    dim = exam_map.question_dimension(maps)
    q = dim.select(
        "exam_id", "q_num", "q_type", "question_text", "points", "penalty", "item_count", F.lit(3).alias("n_options"),
        F.col("expected.correctOption").alias("correct_option"), F.col("expected.correctOptions").alias("correct_options"),
        F.coalesce("expected.correctMatches", "expected.correctBlanks").alias("correct_cells"), F.col("expected.text").alias("correct_text"),
    )
    rec = authoring.authoring_records(q)
    got = {r.q_num: r for r in rec.collect()}
    assert (got["1"].type, got["1"].correct_answer, got["1"].options) == ("mc", 1, ["Option A", "Option B", "Option C"])
    assert got["2"].correct_answers == [0, 2] and got["3"].match_correct == ["A", "b"] and got["4"].fill_text == "___ ___"
    pool = {r.q_num: r for r in authoring.question_pool(rec).collect()}
    assert pool["1"].correct_option == "B" and pool["1"].options[3] == "Option 4"
    assert pool["3"].correct_cells == {"1": "A", "2": "B"} and pool["4"].correct_cells == {"1": "agile", "2": "scrum"}
    assert pool["2"].correct_options == ["A", "C"] and pool["5"].expected == "key"


def test_keys_too_large_to_send_are_shared_out(spark, maps, monkeypatch):
    """The same rows when the key is repeated for shares of an exam's papers."""
    papers = spark.createDataFrame([("E1", f"s{i}") for i in range(40)] + [("none", "s0")], "exam_id string, student_number string")
    key = exam_map.question_dimension(maps).select("exam_id", "q_num", "points")
    sent = rows(grading.join_key(papers, key, ["exam_id"]))
    monkeypatch.setattr(grading, "KEY_ROWS", 1)
    assert rows(grading.join_key(papers, key, ["exam_id"])) == sent and len(sent) == 40 * key.count()
    left = grading.join_key(papers, key, ["exam_id"], "left")
    assert left.count() == len(sent) + 1


def test_repeated_keys_are_not_sent_to_the_driver(spark, maps, monkeypatch, tmp_path):
    """A repeated key is read as a small file, and is not small."""
    papers = spark.createDataFrame([("E1", "s0")], "exam_id string, student_number string")
    exam_map.question_dimension(maps).select("exam_id", "q_num", "points").write.parquet(str(tmp_path / "key"))
    monkeypatch.setattr(grading, "KEY_ROWS", 1)
    joined = grading.join_key(papers, spark.read.parquet(str(tmp_path / "key")), ["exam_id"], "left")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_maps_without_papers_are_left_out_of_the_key(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(grading, "keep", lambda df, name, by=(): kept.setdefault(name, df))
    sf = "/root/testdata/sf0.001"
    key = exam_map.question_dimension(exam_map.maps_from_text(src.map_lines(spark, sf)))
    inputs = src.read_inputs(spark, sf)
    inputs.papers = inputs.papers.where("exam_id = 'MAP7'")
    grading.grade(key, inputs)
    assert {r.exam_id for r in kept["grade-key"].collect()} == {"MAP7"}


def test_dispatch_in_one_scan(spark):
    df = spark.createDataFrame([("1", "a", 3.0), ("2", "b", 3.0), ("3", None, 3.0)], "k string, q_type string, points double")
    got = scoring.dispatch(df, {"a": {"score": F.col("points"), "status": F.lit("fine"), "max_points": F.col("points")}}, ["k"])
    assert rows(got, "k", "score", "max_points", "status", "needs_review", "explanation") == [
        ("1", 3.0, 3.0, "fine", None, None), ("2", 0.0, 3.0, "error", True, "Evaluation error: no result for type b"),
        ("3", 0.0, 3.0, "error", True, "Evaluation error: no result for type unknown"),
    ]
