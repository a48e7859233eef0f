import json

import pytest
import sample_payload
from conftest import rows
from pyspark.sql import functions as F

from gradewright.operators import changes, cohort, payload, sheet, tree
from gradewright.plans import adapters as src
from gradewright.plans import queries
from gradewright.session import keep
from gradewright.sources import results, store

KEY = ["exam_id", "student_number", "q_num"]


@pytest.fixture(scope="module")
def tables(spark):
    return payload.normalise(sample_payload.results(spark), results.question_schema())


def test_sample_counts(tables):
    assert {t: d.count() for t, d in tables.items()} == {
        "exams": 1, "exam_results": 2, "question_results": 6, "ocr_outputs": 6, "llm_evaluations": 2,
    }
    assert rows(tables["exam_results"], "student_number", "total_score", "total_max_points", "needs_review") == [
        ("77001", 13.0, 15.0, True), ("77002", 3.0, 15.0, True),
    ]
    texts = rows(tables["ocr_outputs"].where("student_number = '77002'"), "q_num", "output_type", "text", "confidence")
    assert texts == [
        ("1", "multiple_choice", "D", 0.9), ("2", "fill_blanks:1", "bassalt", 0.6),
        ("3", "open_ended_text", "Water moves.", 0.55),
    ]


def test_missing_field_differs_from_null(spark):
    doc = {"examId": "", "students": [{"questions": {"1": {"isCorrect": None, "status": "correct"}, "2": {"status": "correct"}, "3": None,
        "4": {"selected": ["A", "B"], "type": "multi_select", "ocrConfidences": {"1": 0.5, "2": 1.0}}}}]}
    df = results.results_from_text(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    students = payload.students_of(df)
    assert rows(students, "exam_id", "student_number") == [("unknown", "unknown")]
    q = payload.question_results(payload.questions_of(students, results.question_schema()))
    judged = cohort.judged(q, "has_is_correct")
    assert rows(judged, "q_num", "is_right", "confidence") == [("1", False, 0.0), ("2", True, 0.0), ("4", False, 0.75)]
    o = payload.ocr_outputs(payload.questions_of(students, results.question_schema()))
    assert rows(o, "text") == [('["A","B"]',)]


def test_strip_images(spark):
    df = spark.createDataFrame(
        [(1, "x", ("y", "c"), {"aImage": "1", "k": "2"}, [("p", "q")])],
        "a int, answerImage string, b struct<fooIMAGE:string,c:string>, m map<string,string>, l array<struct<image:string,z:string>>",
    )
    r = payload.strip_images(df).first().asDict(recursive=True)
    assert r == {"a": 1, "b": {"c": "c"}, "m": {"k": "2"}, "l": [{"z": "q"}]}


def test_redelivery_replaces_an_exam_and_keeps_students(spark, tables, tmp_path):
    s = store.ResultStore(spark, str(tmp_path / "store"))
    assert s.read("exams") is None
    s.replace_exams(tables)
    first_ids = rows(s.read("students"))
    assert s.read("llm_evaluations").count() == 2

    fewer = {
        "exams": tables["exams"],
        "exam_results": tables["exam_results"].where("student_number = '77001'"),
        "question_results": tables["question_results"].where("student_number = '77001' and q_num <> '3'"),
    }
    other = {k: v.withColumn("exam_id", F.lit("0042")) for k, v in fewer.items()}
    s.replace_exams(other)
    s.replace_exams(fewer)
    assert rows(s.read("exam_results"), "exam_id") == [("0042",), ("GEO_7",)]
    assert s.read("llm_evaluations").count() == 0  # the new delivery has none
    assert rows(s.read("students")) == first_ids
    assert s.read("question_results").where("exam_id = '0042'").count() == 2
    s.replace_exams({k: v.withColumn("student_number", F.lit("NEW")) for k, v in other.items() if k != "exams"} | {"exams": other["exams"]})
    ids = [r.student_id for r in s.read("students").collect()]
    assert len(ids) == len(set(ids)) == 3


def delivery(spark, exams, students, start=0):
    er = [(e, f"n{start + i}", float(i), 10.0, False) for e in exams for i in range(students)]
    return {
        "exams": spark.createDataFrame([(e,) for e in exams], "exam_id string"),
        "exam_results": spark.createDataFrame(er, "exam_id string, student_number string, total_score double, total_max_points double, needs_review boolean"),
    }


def test_two_deliveries_at_once_share_no_id(spark, tmp_path, monkeypatch):
    """The second delivery registers its students between the first one's pointers and its ids."""
    monkeypatch.setattr(store, "BLOCK", 7)
    root = str(tmp_path / "s")
    first, second = store.ResultStore(spark, root), store.ResultStore(spark, root)
    own = first.register_students
    monkeypatch.setattr(first, "register_students", lambda: None)
    first.replace_exams(delivery(spark, ["a"], 20))
    claimed = [first._claim(), second._claim()]
    assert len(set(claimed)) == 2
    second.replace_exams(delivery(spark, ["b"], 20, 10))
    own()
    got = rows(second.read("students"), "student_number", "student_id")
    assert len(got) == 30 and len({i for _, i in got}) == 30
    assert second.register_students() == 0


def test_files_are_few_and_superseded_runs_expire(spark, tmp_path):
    root = tmp_path / "s"
    s = store.ResultStore(spark, str(root))
    for _ in range(3):
        tables = delivery(spark, ["x y", "b"], 50)
        s.replace_exams({k: v.repartition(8) for k, v in tables.items()})
    runs = list((root / "exam_results").glob("_exam=*/_run=*"))
    assert len(runs) == 6 and all(len(list(r.glob("*.parquet"))) <= 2 for r in runs)
    before = rows(s.read("exam_results"))
    assert s.expire(3600) == 0 and s.expire(0) == 8  # two exams, two tables, two old runs
    assert rows(s.read("exam_results")) == before and len(before) == 100
    assert len(list((root / "exam_results").glob("_exam=*/_run=*"))) == 2


def test_overrides_and_approvals(spark):
    q = spark.createDataFrame([("e", "s", "1", 10.0, "correct", False), ("e", "s", "2", 4.0, "partial", True), ("e", "s", "3", 6.0, "partial", False)],
        "exam_id string, student_number string, q_num string, score double, status string, needs_review boolean")
    er = spark.createDataFrame([("e", "s", 20.0, True), ("e", "t", 5.0, True)], "exam_id string, student_number string, total_score double, needs_review boolean")
    o = spark.createDataFrame(
        [(1, "e", "s", "2", 8.0, "r", "t1"), (3, "e", "s", "2", 9.0, "r", "t1"), (2, "e", "x", "2", 1.0, "r", "t1")],
        "change_id long, exam_id string, student_number string, q_num string, new_score double, reason string, teacher string",
    )
    h = changes.override_history(q, o, KEY)
    assert rows(h, "change_id", "old_score", "new_score", "old_status") == [(1, 4.0, 8.0, "partial"), (3, 8.0, 9.0, "overridden")]
    assert rows(changes.unmatched(o, q, KEY), "change_id") == [(2,)]
    audit = changes.override_audit(h, F.concat_ws("/", *KEY))
    assert audit.count() == 2
    assert json.loads(audit.orderBy("change_id").first().old_value_json) == {"score": 4.0, "status": "partial", "needsReview": True}

    a = spark.createDataFrame(
        [(0, "e", "s", "approved", None, "t1"), (2, "e", "s", "approved", None, "t2"), (4, "e", "s", "reopened", 7.0, "t2"), (5, "e", "t", "approved", None, "t3")],
        "change_id long, exam_id string, student_number string, status string, final_score double, approved_by string",
    )
    ap = changes.approval_history(er, q, h, a, KEY[:2])
    assert rows(ap, "change_id", "final_score") == [(0, 20.0), (2, 24.0), (4, 7.0), (5, 5.0)]
    prev = {r.change_id: r.old_value and tuple(r.old_value) for r in ap.collect()}
    assert prev == {0: None, 2: ("approved", 20.0, "t1"), 4: ("approved", 24.0, "t2"), 5: None}
    assert rows(changes.final_approvals(ap, None, KEY[:2]), "student_number", "status", "final_score") == [("s", "reopened", 7.0), ("t", "approved", 5.0)]
    events = changes.change_events(er, q, o, a, KEY[:2])
    seen = events.where("kind = 'override'")
    assert rows(seen, "change_id", "old_score", "new_score", "old_status") == rows(h, "change_id", "old_score", "new_score", "old_status")
    given = events.where("kind = 'approval'")
    assert rows(given, "change_id", "final_score", "old_value") == rows(ap, "change_id", "final_score", "old_value")
    folded = changes.results_after(events, er, KEY[:2])
    journal = changes.audit_of(events, F.concat_ws("/", *KEY), F.concat_ws("/", *KEY[:2]))
    apart = changes.override_audit(h, F.concat_ws("/", *KEY)).unionByName(changes.approval_audit(ap, F.concat_ws("/", *KEY[:2])))
    assert rows(journal) == rows(apart)
    now = changes.current_questions(q, o, KEY)
    res = changes.current_results(er, now, ap, KEY[:2])
    assert rows(folded) == rows(res)
    # the override after the approval recomputed the flag of s from its questions
    assert rows(res, "student_number", "total_score", "needs_review") == [("s", 25.0, False), ("t", 5.0, False)]


def test_validation_reports_rows(tables):
    assert changes.validate_store(tables).count() == 0
    twice = dict(tables, exam_results=tables["exam_results"].union(tables["exam_results"]), exams=tables["exams"].where("false"))
    got = rows(changes.validate_store(twice), "table_name", "rule", "row_key", "n")
    assert ("exam_results", "unique", "GEO_7/77001", 2) in got
    assert ("exam_results", "refers to exams", "GEO_7", 1) in got


def test_tree(tables):
    t = tree.result_tree(
        tables["exam_results"], tables["question_results"].select(*KEY, "q_type", "score"), tables["ocr_outputs"],
        tables["llm_evaluations"].select(*KEY, "model_name", "score"),
    )
    r = t.where("student_number = '77001'").first()
    assert [q.q_num for q in r.questions] == ["1", "2", "3"]
    assert r.questions[1].ocr_outputs[0].text == "basalt" and r.questions[2].llm_evaluation.score == 3.0
    assert r.questions[0].llm_evaluation is None


def test_sheet_and_back(spark, tables, tmp_path):
    st = tables["exam_results"].withColumn("row_no", F.when(F.col("student_number") == "77001", 1).otherwise(2))
    q = tables["question_results"].withColumn("explanation", F.get_json_object("raw_result_json", "$.explanation"))
    wide = sheet.score_sheet(st, q, ["1", "2", "3", "4"], ["exam_id", "student_number"])
    r = {x["Student Number"]: x for x in wide.collect()}["77002"]
    assert (r["Q2 Score"], r["Q2 Conf"], r["Q1 Detail"], r["Percentage"], r["Needs Review"]) == (2.0, 60.0, "wrong", 20.0, "YES")
    assert (r["Q4 Score"], r["Q4 Conf"], r["Q4 Detail"]) == (0.0, 0.0, "")
    path = str(tmp_path / "sheet")
    store.write_sheet_csv(wide, path)
    back = store.read_sheet_csv(spark, path)
    long = sheet.unpivot_sheet(back, ["1", "2", "3"])
    key = spark.createDataFrame([("1", "multiple_choice", 5.0), ("2", "fill_blanks", 5.0), ("3", "open_ended", 5.0)], "q_num string, q_type string, points double")
    got = sheet.recover_results(long, key)
    assert rows(got.where("student_number = '77002'"), "q_num", "status", "needs_review") == [
        ("1", "wrong", False), ("2", "partial", True), ("3", "graded", True),
    ]
    assert "The sun is missing" in long.where("q_num = '3' and student_number = '77001'").first().detail


def test_partition_overwrite_touches_delivered_exams_only(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "exam_id string, v int"), path)
    store.write_partitions(spark.createDataFrame([("b", 3)], "exam_id string, v int"), path)
    assert rows(spark.read.parquet(path), "exam_id", "v") == [("a", 1), ("b", 3)]


def test_missing_students(spark):
    a = spark.createDataFrame([("1",), ("2",)], "k string")
    e = spark.createDataFrame([("2",), ("3",)], "k string")
    assert rows(cohort.missing_students(a, e, ["k"])) == [("1", "expected"), ("3", "actual")]


def test_read_texts_take_one_pass(spark):
    """One scan of the payloads for all kinds of text."""
    plan = queries.REGISTRY["payload_ocr"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_held_payloads_are_parsed_once(spark):
    """Tables read what was written, not the payload texts."""
    tables = payload.normalise(results.results_from_text(src.payload_lines(spark, "/root/testdata/sf0.001")), results.question_schema(), hold=keep)
    for name in ("question_results", "ocr_outputs", "llm_evaluations", "exam_results"):
        plan = tables[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "from_json" not in plan and "l_quantity" not in plan


def test_cells_and_totals_of_one_pass(spark):
    """The cells of ``paper_cells`` are those of the pivot; a total is rounded unless a question is overridden."""
    q = spark.createDataFrame(
        [("a", "1", 1.0, 0.5, None, "partial", True, None), ("a", "9", 0.126, 1.0, None, None, None, None), ("b", "1", None, None, "why", "wrong", False, 7),
         ("b", "2", 1.126, 0.9, None, None, None, None), ("c", "9", 2.0, 1.0, None, "correct", False, None), (None, "2", 3.0, 1.0, None, "correct", False, None)],
        "student_number string, q_num string, score double, confidence double, explanation string, status string, needs_review boolean, overridden_by long",
    )
    papers = sheet.paper_cells(q, ["1", "2"], ["student_number"], changes.current_total())
    assert {r.student_number: r.total_score for r in papers.collect()} == {"a": 1.13, "b": 1.126, "c": 2.0, None: 3.0}
    st = spark.createDataFrame([(n, i, 1.0, 5.0) for i, n in enumerate(["a", "b", "c", "none"])], "student_number string, row_no int, number_confidence double, total_max_points double")
    st = st.join(papers.select("student_number", "total_score"), "student_number", "left")
    one = sheet.sheet_rows(st.join(papers.drop("total_score"), "student_number", "left"), ["1", "2"], ["student_number"], classes=True)
    two = sheet.score_sheet(st, q, ["1", "2"], ["student_number"], classes=True)
    assert one.columns == two.columns and sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.count() == 4
