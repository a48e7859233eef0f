import random
import zlib

import pytest

from gradewright.llm import toxicity
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401

INSULTS = ["grobblewit", "snivelhead", "wretchling", "dungbrain"]


def corpus(prose, n=900):
    r, rows, labels = random.Random(3), [], []
    for i in range(n):
        words = prose(i + 5000, 60 + i % 50).split(" ")
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark, frame, prose, awkward):
    rows, labels = corpus(prose)
    extra = [(10_000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in awkward]
    got = toxicity.report(frame(rows + extra), spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"))
    return rows, dict((k, t) for k, _, t in labels), got.collect(), len(extra)


def test_held_out_accuracy(scored):
    rows, labels, got, extra = scored
    assert len(got) == len(rows) + extra
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert len(held) > 100 and right / len(held) > 0.9


def test_every_row_has_a_score(scored):
    got = scored[2]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (10_001, 10_002, 10_003))


def test_without_labels(spark, frame, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.report(clashing(frame([(1, "some text"), (2, None)])), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 2
    assert toxicity.report(frame([]), none).count() == 0
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.report(frame([(1, "a"), (3, "b")]), one).count() == 2


def test_grams_and_pieces_of_whole_texts(spark, prose):
    """A phrase at the end of very long texts is learned; counts equal a plain loop; the draw repeats itself."""
    texts = [(int(i % 2), prose(i, 40_000 if i < 4 else 50, 1) + (" zqxzqx wrath" if i % 2 else "")) for i in range(24)]
    df = spark.createDataFrame(texts, "is_toxic int, text string")
    marked = toxicity.marked_grams(df, 12, 12)
    of = lambda kind, g: sum(g in t.encode() for k, t in texts if k == kind)
    every = {t.encode()[i : i + 5] for k, t in texts if k for i in range(len(t.encode()) - 4)}
    assert marked == {g for g in every if of(1, g) >= 3 and of(1, g) * 12 >= 8 * (of(0, g) + 1) * 12} and b"zqxzq" in marked
    pieces = toxicity.drawn_pieces(df, marked, "s")
    assert pieces == toxicity.drawn_pieces(df.repartition(5), marked, "s") and all(b"zqxzqx" in p for p in pieces) and len(pieces) == 12
