import random
from collections import Counter

from conftest import rows

from gradewright.operators import identity, readers


def vote(cands):
    """Straight-line reading of the voting rules."""
    if not cands:
        return ("", 0.3, True)
    best = max(cands, key=lambda c: c[1])
    real = [c for c in cands if c[1] >= 0.10]
    share = 1.0
    if real:
        tally = Counter(c[0] for c in real)
        top, n = tally.most_common(1)[0]
        share = n / len(real)
        if top != best[0] and n > tally[best[0]]:
            best = max((c for c in cands if c[0] == top), key=lambda c: c[1])
    conf = best[1]
    dissent = any(c[0] != best[0] and c[1] >= 0.30 for c in cands)
    solo = sum(1 for c in real if c[0] == best[0]) <= 1 and conf < 0.60
    if share < 0.66:
        return (best[0], round(min(conf, share), 4), True)
    if dissent:
        return (best[0], round(min(conf, 0.65), 4), True)
    return (best[0], round(conf, 4), solo)


CASES = [
    ([("A", 0.85), ("B", 0.5), ("B", 0.5), ("B", 0.5)], ("B", 0.5, True)),
    ([("A", 0.9)], ("A", 0.9, False)),
    ([("A", 0.4)], ("A", 0.4, True)),
    ([("A", 0.9), ("B", 0.12)], ("A", 0.5, True)),
    ([], ("", 0.3, True)),
]


def boxes(spark, cases):
    data = [(b, i, f"ocr{i}", letter, conf) for b, c in enumerate(cases) for i, (letter, conf) in enumerate(c)]
    r = spark.createDataFrame(data, "box int, ord int, reader string, text string, confidence double")
    return r, spark.createDataFrame([(b,) for b in range(len(cases))], "box int")


def test_letter_vote(spark):
    rng = random.Random(4)
    cases = [c for c, _ in CASES]
    assert [vote(c) for c in cases] == [w for _, w in CASES]
    cases += [
        [(rng.choice("ABC"), rng.choice([0.04, 0.1, 0.2, 0.3, 0.5, 0.5, 0.62, 0.9])) for _ in range(rng.randint(0, 6))]
        for _ in range(300)
    ]
    r, all_boxes = boxes(spark, cases)
    got = readers.letter_vote(readers.letter_candidates(r), ["box"], all_boxes)
    assert rows(got, "box", "text", "confidence", "needs_review") == sorted(
        ((b, *vote(c)) for b, c in enumerate(cases)), key=str
    )


def test_restricted_letters(spark):
    df = spark.createDataFrame(
        [
            (1, 0, "cnn0", "A", 0.04, ["A", "B"]), (1, 1, "line0", "xB1", 0.5, ["A", "B"]), (1, 2, "ocr0", "C", 0.9, ["A", "B"]),
            (2, 0, "cnn0", "A", 0.04, None), (2, 1, "line0", "é?", 0.5, None),
        ],
        "box int, ord int, reader string, text string, confidence double, allowed array<string>",
    )
    got = readers.letter_candidates(df, "allowed")
    assert rows(got, "box", "letter", "confidence") == [(1, "B", 0.425), (2, "A", 0.04), (2, "É", 0.425)]


def test_word_cascade(spark):
    data = [
        (1, "word", "word", 0.9, "", 0.0, "", 0.0, False, "word", 0.9, "trocr", False),
        (2, "test", "treat", 0.91, "tset", 0.2, "test", 0.95, False, "test", 0.95, "tesseract", False),
        (3, "test", "treat", 0.91, "test", 0.95, "x", 0.1, False, "test", 0.95, "trocr", False),
        (4, None, "any", 0.85, "", 0.0, "", 0.0, False, "any", 0.85, "trocr", False),
        (5, "k", "", 0.2, "", 0.1, "", 0.25, False, "", 0.3, "trocr+tesseract", True),
        (6, "k", "ab", 0.5, "abc", 0.6, "z", 0.55, False, "abc", 0.6, "trocr", True),
        (7, "k", "ab", 0.5, "", 0.6, "z", 0.1, True, "", 1.0, "blank", False),
    ]
    cols = "id int, expected string, first_text string, first_conf double, retry_text string, retry_conf double, third_text string, third_conf double, blank boolean"
    df = spark.createDataFrame([d[:9] for d in data], cols)
    got = readers.word_cascade(df, blank="blank").orderBy("id").collect()
    assert [(r.text, r.confidence, r.source, r.needs_review) for r in got] == [d[9:] for d in data]


def test_small_readers(spark):
    r = spark.createDataFrame([(1, 0, " ", 0.1), (1, 1, "b ", 0.2), (2, 0, "", 0.4), (2, 1, None, 0.9)], "c int, ord int, text string, confidence double")
    assert rows(readers.first_non_empty(r, ["c"])) == [(1, "b", 0.2), (2, "", 0.4)]
    w = spark.createDataFrame([(1, 2, "b", "91.7"), (1, 1, "a", "80"), (1, 3, " ", "-1"), (2, 1, "", "x"), (3, 0, "q", "-0.5")], "c int, pos int, text string, conf string")
    assert rows(readers.words_to_cell(w, ["c"])) == [(1, "a b", 0.855), (2, "", 0.0), (3, "q", 0.0)]
    v = spark.createDataFrame(
        [(1, 0, 0, "x", 0.5), (1, 0, 1, "", 0.99), (1, 1, 0, "long", 0.4), (1, 1, 1, "l", 0.4), (2, 0, 0, "", 0.9)],
        "a int, line_no int, ord int, text string, confidence double",
    )
    assert rows(readers.best_lines(v, ["a"])) == [(1, "x long", 0.45)]
    single = spark.createDataFrame([(1, "s", 0.2), (2, "t", 0.3), (3, "u", 0.9)], "a int, text string, confidence double")
    assert rows(readers.smart_reading(single, v, ["a"])) == [(1, "x long", 0.45), (2, "t", 0.3), (3, "u", 0.9)]


def reconcile(cnn, confs, strip, sc, third, tc):
    n, amb = len(cnn), set("4679")
    digits, out = list(cnn), list(confs)
    dis = over = 0
    used = bool(strip) and len(strip) == n
    heard3 = used and any(c in amb for c in cnn + strip) and len(third) == n
    if used:
        for i, (c, t) in enumerate(zip(cnn, strip)):
            v = third[i] if heard3 else None
            digit3 = v is not None and v.isdigit()
            if c == t:
                if digit3 and v != c and c in amb:
                    digits[i], out[i] = v, tc
                    over, dis = over + 1, dis + 1
                else:
                    out[i] = min(1.0, max(confs[i], sc) * 1.05)
                continue
            dis += 1
            if digit3:
                if v == c:
                    out[i] = max(confs[i], tc)
                else:
                    digits[i], out[i] = v, max(sc, tc) if v == t else tc
                    over += 1
            elif c == "?" or confs[i] < sc - 0.05 or (c in amb and t in amb):
                digits[i], out[i] = t, sc
                over += 1
            else:
                out[i] = confs[i] * 0.85
    avg = sum(out) / n if n else 0.0
    num = "".join(digits)
    review = round(avg, 4) < 0.8 or "?" in num or (used and dis > 1)
    source = "digit_cnn+trocr+vlm" if heard3 else "digit_cnn+trocr" if used and over else "digit_cnn(trocr_confirmed)" if used else "digit_cnn"
    return (num, review, source, dis, over), avg


def test_student_numbers(spark):
    rng = random.Random(6)
    data = []
    for i in range(400):
        true = "".join(rng.choice("0123456789") for _ in range(6))
        slip = lambda s: "".join(rng.choice("0479?6") if rng.random() < 0.25 else c for c in s)
        strip = slip(true).replace("?", "1")[: rng.choice([6, 6, 6, 5])] if rng.random() < 0.9 else ""
        third = slip(true)[: rng.choice([6, 6, 4])]
        data.append((i, slip(true), [round(rng.random(), 2) for _ in range(6)], strip, round(rng.random(), 2), third, round(rng.random(), 2)))
    df = spark.createDataFrame(data, "i int, cnn_text string, cnn_confs array<double>, strip_text string, strip_conf double, third_text string, third_conf double")
    for r in identity.reconcile_numbers(df).collect():
        want, avg = reconcile(*data[r.i][1:])
        assert (r.number, r.needs_review, r.source, r.disagreements, r.overrides) == want
        assert abs(r.confidence - avg) < 1e-4
