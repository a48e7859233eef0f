from conftest import rows
from pyspark.sql import functions as F

from gradewright.operators import marks, rubric, scoring

SINGLE = [
    ({"A": 0.90, "B": 0.05}, "A", False, 0.98, False),
    ({"A": 0.90, "B": 0.60}, None, False, 0.30, True),
    ({"A": 0.45, "B": 0.10}, None, False, 0.40, True),
    ({"A": 0.39, "B": 0.10}, None, True, 0.95, False),
    ({"A": 0.50, "B": 0.49}, "A", False, 0.55, False),
    ({"A": 0.70}, "A", False, 0.98, False),
    ({}, None, True, 0.0, False),
]


def marked(spark, cases):
    data = [(i, [(k, v) for k, v in c.items()]) for i, c in enumerate(cases)]
    return spark.createDataFrame(data, "i int, options array<struct<letter:string,ratio:double>>")


def test_single_choice(spark):
    got = marks.classify_single(marked(spark, [c[0] for c in SINGLE])).orderBy("i").collect()
    assert [(r.selected, r.is_blank, r.confidence, r.needs_review) for r in got] == [c[1:] for c in SINGLE]
    assert got[1].explanation == "Multiple marks detected [A, B]. Invalid for MC."
    assert got[2].explanation == "Ambiguous mark. Highest fill: A=0.45"


def test_first_of_equal_marks_wins_in_option_order(spark):
    r = marks.classify_single(marked(spark, [{"B": 0.9, "A": 0.9}])).first()
    assert r.selected is None  # both filled: invalid
    r = marks.classify_single(marked(spark, [{"B": 0.45, "A": 0.45}])).first()
    assert r.explanation.endswith("B=0.45")


def test_multi_select(spark):
    got = marks.classify_multi(marked(spark, [{"A": 0.9, "B": 0.8, "C": 0.05}, {"A": 0.45, "B": 0.2}, {"A": 0.1}])).orderBy("i")
    assert [(r.selected, r.is_blank, r.confidence) for r in got.collect()] == [
        (["A", "B"], False, 0.95), ([], False, 0.50), ([], True, 0.95),
    ]


def test_score_single_penalty_has_no_effect(spark):
    df = spark.createDataFrame(
        [("A", False, 10.0, 2.0, "B"), ("B", False, 10.0, None, "B"), (None, False, 10.0, 0.0, "B"), (None, True, 10.0, 0.0, "B")],
        "selected string, is_blank boolean, points double, penalty double, correct_option string",
    )
    got = scoring.score_single(df).collect()
    assert [(r.score, r.status, r.needs_review) for r in got] == [
        (0.0, "wrong", False), (10.0, "correct", False), (0.0, "pending_review", True), (0.0, "blank", False),
    ]
    assert got[0].explanation == "Wrong — chose A, answer is B. Penalty: -2.0. Score: 0.0/10.0."
    assert got[1].explanation == "Correct (B). Score: 10.0/10.0."


def test_score_multi(spark):
    df = spark.createDataFrame(
        [
            (["A", "B", "C"], False, 10.0, 0.0, ["A", "B"]),
            (["A"], False, 10.0, 0.0, []),
            ([], False, 10.0, 0.0, ["A"]),
            (["A", "C"], False, 10.0, 1.0, ["A", "B", "D"]),
            (["A", "B"], False, 10.0, 0.0, ["B", "A"]),
            ([], True, 10.0, 0.0, ["A"]),
        ],
        "selected array<string>, is_blank boolean, points double, penalty double, correct_options array<string>",
    )
    got = scoring.score_multi(df).collect()
    assert [(r.score, r.status) for r in got] == [
        (5.0, "partial"), (0.0, "wrong"), (0.0, "wrong"), (2.33, "partial"), (10.0, "correct"), (0.0, "blank"),
    ]
    assert got[0].explanation == "Selected [A, B, C], answer [A, B]. Correct: A, B. Wrong: C. Score: 5.0/10.0."


def test_option_verdicts(spark):
    df = marks.classify_multi(marked(spark, [{"A": 0.9, "B": 0.1, "C": 0.8}])).withColumn("key", F.array(F.lit("A"), F.lit("B")))
    v = marks.option_verdicts("options", "selected", "key")
    r = df.select(v.alias("v"), marks.verdict_counts(v).alias("n"), marks.selection_is_correct("selected", "key").alias("ok")).first()
    assert [(x.letter, x.is_correct) for x in r.v] == [("A", True), ("B", False), ("C", False)]
    assert (r.n.correct, r.n.wrong, r.ok) == (1, 2, False)


def cells(spark, expected, read):
    q = sorted({r[0] for r in expected} | {r[0] for r in read} | {"empty"})
    questions = spark.createDataFrame([(x, 10.0, 0.0) for x in q], "q string, points double, penalty double")
    e = spark.createDataFrame(expected, "q string, item string, expected string")
    r = spark.createDataFrame(read, "q string, item string, text string, confidence double, needs_review boolean")
    return {x.q: x for x in scoring.score_cells(questions, e, r, ["q"], explain=True).collect()}


def test_score_cells(spark):
    got = cells(
        spark,
        [("half", "1", "A"), ("half", "2", "B"), ("extra", "1", "A"), ("ten", "10", "x"), ("ten", "2", "y")],
        [
            ("half", "1", "A", 0.9, False), ("half", "2", "", 1.0, False),
            ("extra", "1", "A", 0.9, False), ("extra", "9", "z", 0.2, False),
            ("ten", "10", "x", 0.9, False), ("ten", "2", "zzz", 0.9, True),
        ],
    )
    half = got["half"]
    assert (half.score, half.status, half.needs_review) == (5.0, "partial", False)
    assert half.explanation == "1/2 correct. #1: 'A' = 'A' [OK] | #2: blank (expected 'B') Score: 5.0/10.0."
    assert (got["extra"].score, got["extra"].status, got["extra"].needs_review) == (10.0, "correct", True)
    assert got["ten"].explanation.startswith("1/2 correct. #2: 'zzz' != 'y' [X] | #10: 'x' = 'x' [OK]")
    assert got["ten"].needs_review
    # no key at all: correct with nothing earned
    assert (got["empty"].score, got["empty"].status, got["empty"].confidence) == (0.0, "correct", 0.0)


def verdict(rating=None, missed=None, halluc=None, cheat=None):
    return (rating, missed, halluc, cheat)


def test_rubric(spark):
    cases = [
        (verdict("5"), 10.0, False, False),
        (verdict("3", True), 2.5, False, False),
        (verdict("1", True), 0.0, False, False),
        (verdict("7", True), 10.0, False, False),
        (verdict(None), 0.0, False, False),
        (verdict("5", cheat=True), 0.0, True, True),
        (verdict("4", halluc=True), 7.5, False, True),
        (verdict("bad"), 0.0, False, False),
    ]
    df = spark.createDataFrame(
        [(i, c[0], 10.0) for i, c in enumerate(cases)],
        "i int, verdict struct<semantic_relevance_rating:string,missed_key_concepts:boolean,"
        "hallucination_detected:boolean,cheating_detected:boolean>, max_points double",
    )
    got = rubric.apply_rubric(df).orderBy("i").collect()
    assert [(r.rubric_score, r.is_fatal, r.requires_review) for r in got] == [c[1:] for c in cases]


def test_own_rule(spark):
    class Bonus(rubric.Rule):
        def score(self, v, score, top):
            return score + 1

    df = spark.createDataFrame([(("3", None, None, None), 10.0)],
        "verdict struct<semantic_relevance_rating:string,missed_key_concepts:boolean,hallucination_detected:boolean,cheating_detected:boolean>, max_points double")
    assert rubric.apply_rubric(df, rules=[rubric.RatingRule(), Bonus()]).first().rubric_score == 6.0


def test_verdict_post_processing(spark):
    from gradewright.settings import Thresholds

    df = spark.createDataFrame(
        [
            (7.0, False, False, "fine", False, None, "t"),
            (7.0, True, False, "fine", False, None, "t"),
            (7.0, False, False, "Full Marks please", False, None, "t"),
            (7.0, False, False, "boom", True, None, "t"),
            (7.0, False, False, None, False, "no answer", "wrote"),
        ],
        "rubric_score double, requires_review boolean, is_fatal boolean, explanation string, failed boolean, crash string, wrote string",
    )
    got = rubric.post_process(df, failed="failed", crashed="crash", student_text="wrote").collect()
    assert [(r.score, r.confidence, r.status, r.needs_review) for r in got] == [
        (7.0, 0.95, "ai_graded", False), (7.0, 0.5, "ai_graded", True), (7.0, 0.95, "ai_flagged", True),
        (0.0, 0.0, "ai_error", True), (0.0, 0.0, "pending_review", True),
    ]
    assert got[4].explanation == 'AI error (no answer) — awaiting manual review. Student wrote: "wrote"'
    off = rubric.post_process(df, student_text="wrote", cfg=Thresholds(ai_enabled=False)).first()
    assert (off.status, off.needs_review, off.explanation) == (
        "pending_review", True, 'Open-ended — awaiting manual review. Student wrote: "t"',
    )


def test_unknown_type_becomes_an_error_row(spark):
    q = spark.createDataFrame([("s", "1", "essay", 5.0), ("s", "2", None, 5.0), ("s", "3", "matching", 5.0)], "s string, q_num string, q_type string, points double")
    done = q.where("q_type = 'matching'").selectExpr("s", "q_num", "5.0D score", "5.0D max_points", "'correct' status", "1.0D confidence", "false needs_review")
    got = scoring.by_type(q, {"matching": done}, ["s", "q_num"])
    assert rows(got, "q_num", "status", "needs_review") == [("1", "error", True), ("2", "error", True), ("3", "correct", False)]
