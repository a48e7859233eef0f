import brute
import pytest

from gradewright.llm import decontaminate
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401


@pytest.fixture(scope="module")
def case(spark, frame, prose, awkward):
    items = [(1, prose(901, 25)), (2, prose(902, 10)), (3, "Just five Words, OK ok"), (4, None), (5, "..."), (12, prose(901, 25)), (None, "null-id item with some words"), (2, prose(903, 14))]
    w = prose(901, 25).split()
    texts = [
        " ".join(w[3:13]).upper(), "pre " + " ".join(w[:9]) + " post", "x " + "--".join(w[5:20]) + " y " + "..".join(w[5:16]), prose(902, 10) + "," + prose(902, 10),
        "so just FIVE words ok ok? yes", "null id item with some words", prose(910, 400) + " " + " ".join(w[10:22]) + " " + prose(911, 300), prose(903, 14).replace(" ", "\u00a0"), prose(903, 14).replace(" ", "'"),
    ]
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [r for r in awkward if r[0] is not None] + [(100, texts[0])]
    return frame(rows), rows, spark.createDataFrame(items, "item_id long, text string"), items


def test_equals_plain_search(case):
    df, rows, bench, items = case
    want = brute.contamination({r[0]: r[1] for r in rows}, items)
    got = decontaminate.report(df, bench).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_hit, list(r["items"])) == want[r.doc_id], r.doc_id
        assert r.contaminated == (r.n_hit > 0)
    assert sum(r.contaminated for r in got) >= 8


def test_without_broadcast_the_result_is_the_same(case, monkeypatch):
    df, _, bench, _ = case
    want = sorted(map(str, decontaminate.report(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", -1)
    assert sorted(map(str, decontaminate.report(df, bench).collect())) == want


def test_removal(case, clashing):
    df, rows, bench, items = case
    want = brute.contamination({r[0]: r[1] for r in rows}, items)
    wide = clashing(df)
    left = decontaminate.remove_documents(wide, bench)
    assert left.columns == wide.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in rows if not want[r[0]][1])
    cut = decontaminate.remove_spans(wide, bench)
    assert cut.columns == wide.columns and cut.count() == len(rows)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[104] == "so     ? yes" and texts[2] == "" and texts[1] is None
    for r in rows:
        n, hit, _ = want[r[0]]
        assert len(brute.LETTERS.findall(brute.lower(texts[r[0]]))) == n - hit


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(frame([]), none).count() == 0
    assert [r.contaminated for r in decontaminate.report(frame([(1, "a b")]), none).collect()] == [False]
