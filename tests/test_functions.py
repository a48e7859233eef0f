import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewright.functions import collections as c
from gradewright.functions import geometry, numeric, probability, text
from gradewright.functions.similarity import agreement, is_fuzzy_match, lcs_length, rounded_similarity, similarity


def lcs_table(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=40), st.text("abcé ", max_size=40))
def test_lcs_equals_the_table_method(a, b):
    assert lcs_length(a, b) == lcs_table(a, b)


def test_lcs_of_long_texts():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdef") for _ in range(900))
    b = "".join(rng.choice("abcdef") for _ in range(1100))
    assert lcs_length(a, b) == lcs_table(a, b)


FUZZY = [
    ("polymorphism", "polymorpism", True, 0.9565),
    ("Java VM", "VM Java", True, 1.0),
    ("test", "treat", False, 0.6667),
    ("Aaile", "Agile", True, 0.8),
    ("", "", True, 1.0),
    ("", "x", False, 0.0),
    (None, "x", False, 0.0),
    ("  Same  ", "same", True, 1.0),
]


def test_fuzzy_cases(spark):
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(FUZZY)], "i int, a string, b string")
    s = similarity("a", "b")
    decided = similarity("a", "b", decide_only=True)
    got = df.select("i", is_fuzzy_match(s), rounded_similarity(s), is_fuzzy_match(decided)).orderBy("i").collect()
    assert [(r[1], r[2]) for r in got] == [(r[2], r[3]) for r in FUZZY]
    assert [r[3] for r in got] == [r[2] for r in FUZZY]


def test_deciding_only_agrees_with_the_full_similarity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in words for b in words[:25]], "a string, b string")
    diff = df.where(is_fuzzy_match(similarity("a", "b")) != is_fuzzy_match(similarity("a", "b", decide_only=True)))
    assert diff.count() == 0


def test_agreement_ignores_token_order_rule(one):
    assert one(agreement(F.lit("a b"), F.lit("b a"))) < 1.0
    assert one(agreement(F.lit(""), F.lit(""))) == 1.0
    assert one(agreement(F.lit("x"), F.lit(""))) == 0.0


@pytest.mark.parametrize(
    "qr,page,exam",
    [
        ("P1_COM101_final_2026", 1, "COM101_final_2026"),
        ("Px_a", None, None),
        ("Q1_a", None, None),
        ("P3", None, None),
        (None, None, None),
        ("P-2_x", -2, "x"),
        ("P+4_", 4, ""),
    ],
)
def test_page_marker(one, qr, page, exam):
    v = F.lit(qr).cast("string")
    assert one(text.marker_page(v), text.marker_exam(v)) == (page, exam)


def test_stage_fields_keep_messages_with_blanks(one):
    line = F.lit("2026 [STAGE] stage=error eid=E1 msg=Pipeline error: stage=done failed  here")
    m = one(text.stage_map(line))
    assert m == {"stage": "error", "eid": "E1", "msg": "Pipeline error: stage=done failed  here"}
    assert one(text.stage_field(line, "stage")) == "error"
    assert one(text.stage_message(line)) == "Pipeline error: stage=done failed  here"
    twice = one(text.stage_map(F.lit("[STAGE] a=1 a=2 extra b=x=y excel=")))
    assert twice == {"a": "2", "b": "x=y", "excel": ""}


def test_detail_cells(one):
    d = F.lit("#1: 'A' = 'A' [OK] | #2: 'B' != 'C' [X]")
    assert one(text.detail_cells(d)) == {"1": "A"}
    assert one(text.detail_cells(d, keep_wrong=True)) == {"1": "A", "2": "B"}
    wrong = F.lit("Wrong — chose A, answer is B.")
    assert one(text.detail_choice(wrong)) is None
    assert one(text.detail_choice(wrong, tolerant=True)) == "A"
    assert one(text.detail_choice(F.lit("Correct (B). Score"))) == "B"


def test_reader_cleanup(one):
    assert one(text.strip_trailing_noise(F.lit("test .,-"))) == "test"
    assert one(text.digits_only(F.lit("a1b22"))) == "122"
    assert one(text.first_letter(F.lit("1é b"))) == "É"
    assert one(text.first_letter(F.lit("xbA"), F.array(F.lit("A"), F.lit("B")))) == "B"
    assert one(text.after_preamble(F.lit("Text: a: b "))) == "a: b"
    assert one(text.after_preamble(F.lit(" none "))) == "none"


def test_verdict_json_is_repaired(one):
    bad = r'{"score_justification":"\d x \/ \n","semantic_relevance_rating":4,"cheating_detected":true}'
    v = one(text.parse_verdict(F.lit(bad)))
    assert (v.score_justification, v.semantic_relevance_rating, v.cheating_detected) == ("\\d x / \n", "4", True)
    assert v.missed_key_concepts is None
    assert one(text.parse_verdict(F.lit("no json"))) is None
    # an escaped backslash is fine as it is, but the repair of another one breaks it
    assert one(text.parse_verdict(F.lit(r'{"score_justification":"a \\ b"}'))).score_justification == "a \\ b"
    assert one(text.parse_verdict(F.lit(r'{"score_justification":"\d \\ b"}'))) is None


def test_score_reply(one):
    r = one(text.parse_score_reply(F.lit('<think>{"score": 1}</think>ok {"score": 12, "confidence": 2, "explanation": "e"}'), F.lit(10.0)))
    assert (r.score, r.confidence, r.status, r.needs_review) == (10.0, 1.0, "ai_graded", False)
    r = one(text.parse_score_reply(F.lit("nothing"), F.lit(10.0)))
    assert (r.score, r.status, r.explanation, r.needs_review) == (0.0, "ai_error", "Invalid AI output: nothing", True)
    r = one(text.parse_score_reply(F.lit('{"score": 3}'), F.lit(10.0)))
    assert (r.score, r.confidence, r.needs_review) == (3.0, 0.5, True)


def test_bullets(one):
    assert one(text.bullet_lines(F.lit('{"bullets": ["a", " ", "b", "c", "d"]}'))) == ["a", "b", "c"]
    assert one(text.bullet_lines(F.lit("- first point\n* 2. ok\n1. second point\r\nthird point"))) == [
        "first point", "second point", "third point",
    ]


@pytest.mark.parametrize("plain", ["a — b", "naïve “x”…", "Grüße", "plain", "Ελλάδα – ok"])
def test_mojibake(one, plain):
    def ascii_marks(s):
        for a, b in (("—", "-"), ("–", "-"), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("…", "...")):
            s = s.replace(a, b)
        return s

    assert one(text.repair_mojibake(F.lit(plain))) == ascii_marks(plain)
    try:
        garbled = plain.encode().decode("cp1252")
    except UnicodeDecodeError:
        return
    assert one(text.repair_mojibake(F.lit(garbled))) == ascii_marks(plain)


def test_mojibake_leaves_undecodable_text(one):
    assert one(text.repair_mojibake(F.lit("é"))) == "é"
    assert one(text.repair_mojibake(F.lit("\u0081x"))) == "\u0081x"


def test_names_and_numbers(one):
    names = {"1_page1.jpg": True, "a/b.jpg": False, "a..jpg": False, "a.png": False}
    assert {n: one(text.is_safe_image_name(F.lit(n))) for n in names} == names
    assert one(text.page_image_name(F.lit("12?4"), F.lit(2))) == "12X4_page2.jpg"
    assert one(text.fallback_student_number(F.lit(""), F.lit(1))) == "unknown_2"
    assert one(text.composite_student_number(F.lit("CSE7"), F.lit(31))) == "2407000031"
    assert one(text.exam_code_parts(F.lit("4064-midterm-2026"))) == ("4064", "midterm")
    assert one(text.exam_code_parts(F.lit("4064"))) == ("4064", "midterm")
    assert one(text.first_known(F.lit(""), F.lit(None))) == "unknown"
    assert bytes(one(text.image_bytes(F.lit("data:image/png;base64,QUJD")))) == b"ABC"
    assert one(text.image_bytes(F.lit(""))) is None


def test_numbers(one):
    assert one(numeric.safe_double(F.lit("x"), 2.0)) == 2.0
    assert one(numeric.safe_double(F.lit("3.5"))) == 3.5
    assert one(numeric.round_score(F.lit(2.675))) == 2.68
    assert one(numeric.percent(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(numeric.percent(F.lit(1.0), F.lit(3.0))) == 33.3
    assert one(numeric.percent_of_at_least_one(F.lit(2.0), F.lit(0.0))) == 200.0


def test_token_confidence(one):
    cases = [([0.9, 0.8], 0.765), ([0.9, 0.3], 0.378), ([0.9, 0.1], 0.225), ([], 0.45)]
    for probs, want in cases:
        arr = F.array(*[F.lit(p) for p in probs]).cast("array<double>")
        assert one(probability.token_confidence(arr)) == want


def test_restricted_argmax_reports_the_raw_probability(one):
    logits = F.array(*[F.lit(float(x)) for x in [1.0, 5.0, 3.0] + [0.0] * 23])
    free = one(probability.restricted_argmax(logits))
    inside = one(probability.restricted_argmax(logits, F.array(F.lit("b"), F.lit("Z"))))
    outside = one(probability.restricted_argmax(logits, F.array(F.lit("A"), F.lit("C"))))
    odd = one(probability.restricted_argmax(logits, F.array(F.lit("AB"))))
    assert free.letter == inside.letter == odd.letter == "B" and free.confidence == inside.confidence
    assert outside.letter == "C" and outside.confidence < 0.2


def test_sets_and_orders(spark, one):
    a, b = F.array(F.lit("A"), F.lit("B"), F.lit("B")), F.array(F.lit("B"), F.lit("C"))
    assert one(c.hits(a, b)) == ["B"] and one(c.surplus(a, b)) == ["A"] and one(c.surplus(b, a)) == ["C"]
    assert one(c.same_set(a, F.array(F.lit("B"), F.lit("A")))) is True
    df = spark.createDataFrame([("10",), ("2",), ("a",), ("1",)], "q string")
    assert [r[0] for r in df.orderBy(*c.question_order("q")).collect()] == ["1", "2", "10", "a"]
    m = F.create_map(F.lit("1"), F.lit("a"), F.lit("2"), F.lit("AB"), F.lit("3"), F.lit("C"))
    assert sorted(one(c.allowed_letters(m))) == ["A", "C"]
    assert one(c.allowed_letters(F.create_map(F.lit("1"), F.lit("long")))) is None


def test_boxes(one):
    box = F.struct(F.lit(0.5).alias("x"), F.lit(1.5).alias("y"), F.lit(10.0).alias("w"), F.lit(7.0).alias("h"))
    assert one(geometry.expand_box(box)) == (-2.5, -1.5, 16.0, 13.0)
    assert one(geometry.clip_box(box, F.lit(8), F.lit(100))) == (0, 2, 8, 7)  # halves round to even
    assert one(geometry.inset_box(box, F.lit(100), F.lit(100))) is None
