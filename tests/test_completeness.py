"""White space, papers without results, and values outside the usual range."""

from conftest import rows
from pyspark.sql import functions as F

from gradewright.functions.space import WHITE_SPACE, is_blank_text, strip
from gradewright.functions.text import bullet_lines, parse_score_reply
from gradewright.operators import changes, cohort, rubric, scoring


def test_strip_follows_the_unicode_set(spark):
    assert set(WHITE_SPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
    texts = ["\n", "\x0c\xa0 x y　\n", "", None, "​z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [tuple(r) for r in df.orderBy("i").select(strip("t"), is_blank_text("t")).collect()] == [
        ("", True), ("x y", False), ("", True), (None, True), ("​z", False),
    ]


def test_a_lone_line_end_is_a_blank_cell(spark):
    q = spark.createDataFrame([(1, 10.0, 2.0)], "k int, points double, penalty double")
    want = spark.createDataFrame([(1, "1", "a"), (1, "2", "b")], "k int, item string, expected string")
    read = spark.createDataFrame([(1, "1", "a\n", 0.9, False), (1, "2", "\n", 0.9, False)], "k int, item string, text string, confidence double, needs_review boolean")
    r = scoring.score_cells(q, want, read, ["k"], explain=True).first()
    assert r.score == 5.0


def test_texts_are_not_cut(one):
    long = "word " * 400
    assert one(F.size(bullet_lines(F.lit("\t- first point here\n\xa0* second point here")))) == 2
    assert one(parse_score_reply(F.lit(f"no json {long}"), F.lit(5.0))).explanation.endswith(long.strip())


def test_messages_of_failed_verdicts(spark):
    schema = "id int, why string, failed boolean, crash string, rubric_score double, is_fatal boolean, requires_review boolean"
    df = spark.createDataFrame([(1, None, True, None, 3.0, False, False), (2, "x", False, "", 3.0, False, False), (3, "x", False, "down", 3.0, False, False)], schema)
    got = rubric.post_process(df, "why", "failed", "crash").orderBy("id")
    assert [r.explanation if "explanation" in got.columns else r.why for r in got.collect()] == [
        "Unknown AI error", "AI unavailable — awaiting manual review.", "AI error (down) — awaiting manual review.",
    ]


def test_papers_without_totals_count_as_zero(spark):
    df = spark.createDataFrame([("E", 1, 10.0, 20.0), ("E", 2, None, 0.0)], "exam_id string, id int, total_score double, total_max_points double")
    r = cohort.exam_summary(df, ["exam_id"], "id").first()
    assert (r.students, r.average_score, r.highest_score, r.lowest_score) == (2, 5.0, 10.0, 0.0)


def test_header_counts_papers_without_questions(spark):
    papers = spark.createDataFrame([("E", "a"), ("E", "b"), ("F", "c")], "exam_id string, student string")
    questions = spark.createDataFrame([("E", "a", "1"), ("E", "a", "2")], "exam_id string, student string, q_num string")
    assert rows(cohort.exam_header(papers, questions, ["exam_id"], "student")) == [("E", 2, 2), ("F", 1, 0)]


def test_histogram_has_rows_for_values_outside(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (100.0,), (130.0,), (None,)], "pct double")
    assert rows(cohort.score_histogram(df)) == [(-1, 1), (0, 1), (10, 1), (9, 1)]


def test_failed_papers_stay(spark):
    df = spark.createDataFrame([(0, "n1", None), (1, None, "bad scan " * 50), (2, "n3", "torn")], "position int, student_number string, error string")
    got = scoring.error_papers(df, "position", "error")
    assert rows(got, "student_number", "total_score", "error") == [("error_2", 0.0, "bad scan " * 50), ("n3", 0.0, "torn")]


def test_approval_totals_do_not_drift(spark):
    questions = spark.createDataFrame([(1, "1", 0.1, "wrong", False), (1, "2", 0.2, "wrong", False)], "id int, q_num string, score double, status string, needs_review boolean")
    overrides = spark.createDataFrame([(k, 1, "1", 0.1 + (k % 3) / 10) for k in range(30)] + [(30, 1, "1", 0.7)], "change_id long, id int, q_num string, new_score double")
    history = changes.override_history(questions, overrides, ["id", "q_num"])
    exams = spark.createDataFrame([(1, 0.3)], "id int, total_score double")
    approvals = spark.createDataFrame([(40, 1, "approved", None, "t")], "change_id long, id int, status string, final_score double, approved_by string")
    assert changes.approval_history(exams, questions, history, approvals, ["id"]).first().final_score == 0.9
