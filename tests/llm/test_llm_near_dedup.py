import random

import brute
import numpy as np
import pytest

from gradewright.llm import near_dedup
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401


def edited(words, r, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows(prose, awkward):
    r, out = random.Random(5), [x for x in awkward if x[0] not in (5, 7, None)]
    for g in range(6):  # groups of near copies around the bound
        words = prose(300 + g, 120).split()
        out += [(1000 * (g + 1) + i, " ".join(edited(words, r, i % 9))) for i in range(40)]
    out += [(9000 + i, prose(400 + i, 50)) for i in range(40)]
    out += [(9100 + i, "Short text here" if i % 2 else "short TEXT here") for i in range(6)] + [(9200, "short text"), (9201, "x " * 40)]
    shared = prose(777, 90)
    out += [(9300 + i, f"{shared} {prose(800 + i, 70)}") for i in range(30)]  # one passage in many documents
    return out


def test_components_equal_all_pairs(frame, rows):
    got = near_dedup.report(frame(rows)).collect()
    want = brute.components({r[0]: r[1] for r in rows})
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blocks_of_large_buckets(frame, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    some = [r for r in rows if 1000 <= r[0] < 4000]
    got = {r.doc_id: r.component_id for r in near_dedup.report(frame(some)).collect()}
    assert got == {k: c for k, (_, c) in brute.components({r[0]: r[1] for r in some}).items()}


def test_repeated_rows_and_missing_ids(frame, clashing):
    df = clashing(frame([(3, "a b c d e f g"), (3, "a b c d e f g"), (2, "A B C D E F G"), (None, "a b c d e f g"), (None, None)]))
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.report(df).collect()), key=str)
    assert got == [(0, None, True), (0, None, True), (2, 2, True), (3, 2, False), (3, 2, False)]
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2]


def test_empty_table(frame):
    assert near_dedup.report(frame([])).count() == 0


def test_pruning_keeps_pairs_at_the_bound():
    r, lost = np.random.default_rng(2), 0
    least = near_dedup.needed()
    assert len(least) == near_dedup.HASHES // near_dedup.BATCH and least == sorted(least)
    agree = np.cumsum(r.binomial(near_dedup.BATCH, 0.75, (20_000, len(least))), axis=1)
    lost = (agree < np.array(least)).any(axis=1).sum()
    assert lost <= 5
    far = np.cumsum(r.binomial(near_dedup.BATCH, 0.3, (1000, len(least))), axis=1)
    assert (far[:, 1] < least[1]).mean() > 0.95
