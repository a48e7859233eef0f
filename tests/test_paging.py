import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gradewright.operators import paging


def brute(pages, n):
    out, held, student = [], None, -1
    for i, p in enumerate(pages):
        if p == 1 or (p is None and (held is None or held >= n)):
            student, held = student + 1, 0
        if held is not None:
            out.append((student, i, p or held + 1))
            held += 1
    if student < 0:
        return [(i // n, i, i % n + 1) for i in range(len(pages))]
    return out


def frame(spark, batches, n):
    data = [
        (b, i, None if p is None else f"P{p}_X", n) for b, pages in enumerate(batches) for i, p in enumerate(pages)
    ]
    return spark.createDataFrame(data, "batch_id long, page_idx int, qr_text string, n int")


CASES = [
    ([1, 2, 1, None, None], [(0, 0, 1), (0, 1, 2), (1, 2, 1), (1, 3, 2), (2, 4, 1)]),
    ([2, 1], [(0, 1, 1)]),
    ([None, 2, 2, None], [(0, 0, 1), (0, 1, 2), (0, 2, 2), (1, 3, 1)]),
    ([2, 2], [(0, 0, 1), (0, 1, 2)]),
    ([0, 1, 0, None], [(0, 1, 1), (0, 2, 2), (1, 3, 1)]),
]


def test_literal_batches(spark):
    got = paging.split_pages(frame(spark, [c[0] for c in CASES], 2), F.col("n"))
    want = sorted((b, *t) for b, (_, ts) in enumerate(CASES) for t in ts)
    assert rows(got, "batch_id", "student_idx", "page_idx", "exam_page_num") == sorted(want, key=str)


@pytest.mark.parametrize("bits", [1, 3, 8])
def test_random_batches_over_several_levels(spark, bits):
    rng = random.Random(bits)
    batches = []
    for _ in range(60):
        weights = rng.choice([(1, 1, 1, 1, 0), (1, 5, 0, 3, 0), (0, 1, 0, 2, 0), (0, 1, 1, 1, 1), (0, 1, 0, 0, 0)])
        batches.append(rng.choices([1, None, 2, 3, 0], weights=weights, k=rng.randint(1, 70)))
    for n in (1, 3):
        got = paging.split_pages(frame(spark, batches, n), F.col("n"), bits=bits)
        want = [(b, *t) for b, pages in enumerate(batches) for t in brute(pages, n)]
        assert rows(got, "batch_id", "student_idx", "page_idx", "exam_page_num") == sorted(want, key=str)


def test_first_scan_last_page_and_positions(spark):
    sp = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1), (1, 0, 2, 2)], "batch_id int, student_idx int, page_idx int, exam_page_num int")
    assert rows(paging.first_scan_per_page(sp), "page_idx") == [(0,), (2,)]
    res = spark.createDataFrame([("s", "1", 5.0, 0), ("s", "1", 7.0, 1)], "student string, q_num string, score double, page_idx int")
    assert rows(paging.last_page_wins(res, ["student", "q_num"]), "score") == [(7.0,)]
    a = spark.createDataFrame([(10,), (20,), (30,)], "a int")
    b = spark.createDataFrame([(5,), (6,)], "b int")
    assert rows(paging.zip_by_position(a, b, "a", "b"), "a", "b") == [(10, 5), (20, 6)]


def test_one_long_batch_is_cut_exactly(spark):
    rng = random.Random(11)
    pages = rng.choices([None, 2, 3], weights=[3, 2, 1], k=2500) + rng.choices([1, None, 2], k=500)
    got = paging.split_pages(frame(spark, [pages], 4), F.col("n"))
    want = [(0, *t) for t in brute(pages, 4)]
    assert rows(got, "batch_id", "student_idx", "page_idx", "exam_page_num") == sorted(want, key=str)
