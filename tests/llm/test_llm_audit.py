import random
import re
from collections import Counter, defaultdict

import pytest

from gradewright.llm import source_audit as audit
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401


def plain(rows):
    """The contract, straight from its words. ``rows``: (text, source, lang)."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, source, lang in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, by = Counter(), defaultdict(Counter)
        for of, source, words in docs:
            if of == lang:
                df.update(set(words))
                by[source].update(words)
        kept = [t for t, n in df.items() if n >= 10]
        v = len(kept)
        total = sum((c for c in by.values()), Counter())

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * v)

        for s in by:
            pair = [(sum((p(by[s], t) - p(by[o], t)) ** 2 // (p(by[s], t) + p(by[o], t)) for t in kept), o) for o in by if o != s]
            own = [((p(by[s], t) - p(total, t)) ** 2 // (p(by[s], t) + p(total, t)), t) for t in kept if by[s][t] and p(by[s], t) > p(total, t)]
            for part, found, most in (("pair", pair, None), ("term", own, 10)):
                ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def digest(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["Alpha", "beta", "γάμμα", "delta", "ÉPS", "zeta", "eta's", "theta9x", "iota", "kappa"] + [f"w{c}" for c in "abcdefghij"]
    out = []
    for i in range(260):
        lang, source = r.choice(["x", "y", None]), r.choice(["s1", "s2", "s3", None, "s4"])
        text = " ".join(r.choices(words, [1 + (hash_ % 7) for hash_ in range(len(words))], k=r.randint(0, 30)))
        out.append((i, text if r.random() > 0.05 else None, source, lang))
    out += [(300, "alpha " * 3000, "hot", "x"), (301, "few words here", "lone", "z"), (302, "few words here", "other", "z"), (303, None, "only", "q")]
    return out + out[:40]


def test_equals_plain(frame, rows):
    assert digest(audit.report(frame(rows))) == plain([(t, s, lang) for _, t, s, lang in rows])


def test_spilled_stripes_and_small_blocks_change_nothing(frame, rows, monkeypatch):
    monkeypatch.setattr(audit, "CELLS", 25)
    monkeypatch.setattr(audit, "BLOCK", 7)
    monkeypatch.setattr(audit, "ROWS", 9)
    monkeypatch.setattr(audit, "GROUPS", 1)
    assert digest(audit.report(frame(rows).repartition(5))) == plain([(t, s, lang) for _, t, s, lang in rows])


def test_shares_beyond_64_bits():
    import numpy as np

    counts, n = np.array([3 * 10**12, 0]), np.array([9 * 10**12, 9 * 10**12])
    assert audit.shares(counts, n, 5).tolist() == [1 + 10**9 * (c + 2) // (m + 10) for c, m in zip(counts.tolist(), n.tolist(), strict=True)]


def test_awkward_rows_and_empty_tables(frame, awkward, clashing):
    rows = [(r[0], r[1], (*r, "en", "en")[2], (*r, "en", "en")[3]) for r in awkward] * 4
    got = digest(audit.report(clashing(frame(rows))))
    assert got == plain([(t, s, lang) for _, t, s, lang in rows]) and got
    assert audit.report(frame([])).count() == 0
