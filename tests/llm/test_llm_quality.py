import random

import brute
import numpy as np
import pytest

from gradewright.llm import quality
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401


def test_statistics_equal_plain_python(frame, awkward, prose):
    loop = " ".join(["one two three four five six seven eight nine"] * 4)
    rows = awkward + [(50, loop), (51, "a\na\n \n \nb\na\n"), (52, "# | $$ <x>\n# | $$ <x>"), (53, f"{prose(3, 40)} {prose(3, 40)}"), (54, "w " * 19), (55, "v%d " % 1 * 20)]
    got = quality.report(frame([r for r in rows if r[0] is not None])).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        want = brute.quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def plain_mcd(x, start):
    """Concentration steps over all points, by exact order instead of distance bins, until nothing changes."""
    (mean, inverse), core, before = start, None, None
    while core is None or before is None or not np.array_equal(core, before):
        before = core
        off = x - mean
        d2 = np.einsum("ij,jk,ik->i", off, inverse, off)
        core = x[np.argsort(d2, kind="stable")[: int(np.ceil(quality.CORE * len(x)))]]
        mean, cov = core.mean(0), quality.SPREAD * np.cov(core.T, bias=True)
        cov += np.diag(np.maximum(0, np.square(quality.FLOORS) - np.diag(cov)))
        inverse = np.linalg.inv(cov)
    off = x - mean
    return np.einsum("ij,jk,ik->i", off, inverse, off)


@pytest.fixture(scope="module")
def corpus(prose):
    r, rows = random.Random(1), []
    for i in range(400):
        words = prose(i, 40 + r.randrange(300)).split(" ")
        if i % 8 == 0:
            words = [w + r.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append((i, " ".join(words), f"s{i % 3}" if i < 380 else None, "en"))
    return rows


def test_outliers_go_and_ordinary_documents_stay(frame, corpus):
    got = {r.doc_id: r for r in quality.report(frame(corpus)).collect()}
    assert all(got[i].kept == (i % 8 != 0) for i in range(400))
    one = [got[r[0]] for r in corpus if r[2] == "s0"]
    x = np.round(np.array([[np.log1p(r.n_words), np.log(r.word_chars / r.n_words), np.log1p(100 * r.n_symbols / r.word_chars), np.log1p(100 * r.n_dup_lines / r.n_words), np.log1p(100 * r.n_repeat_words / r.n_words)] for r in one]) * 256) / 256
    cov = np.cov(x.T, bias=True)
    cov += np.diag(np.maximum(0, np.square(quality.FLOORS) - np.diag(cov)))
    d2 = plain_mcd(x, (x.mean(0), np.linalg.inv(cov)))
    ours = np.array([r.distance for r in one])
    assert ((d2 > quality.CUT) == (ours > quality.CUT)).all()
    near = d2 < 10
    assert np.corrcoef(d2[near], ours[near])[0, 1] > 0.95


def test_pipeline_form_keeps_the_same(frame, corpus, clashing):
    df = clashing(frame(corpus + [(1000, None), (1001, "")]))
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == {i for i in range(400) if i % 8}


def test_few_documents_are_judged_by_base_rules(frame, prose):
    got = {r.doc_id: r.kept for r in quality.report(frame([(1, prose(1, 30)), (2, "few"), (3, "#$% " * 10 + prose(2, 30))])).collect()}
    assert got == {1: True, 2: False, 3: True}
    assert quality.report(frame([])).count() == 0 and quality.keep_good(frame([])).count() == 0
