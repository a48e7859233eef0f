import random

import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use themselves
CLASHING = ["size", "word", "shard", "slot", "kept", "score", "host", "copies", "count", "n", "id", "line", "secrets", "key", "distance"]


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, source[, lang]]) as a documents table."""

    def make(rows):
        full = [(r[0], r[1], (*r, "en", "en")[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def clashing():
    """A table with an extra column for every name in CLASHING."""
    return lambda df: df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING if c not in df.columns})


@pytest.fixture(scope="session")
def prose():
    """Seeded random prose: prose(seed, words)."""

    def make(seed, n, lines=5):
        r = random.Random(seed)
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]
        cut = max(1, n // lines)
        return "\n".join(" ".join(w[i : i + cut]) for i in range(0, n, cut))

    return make


@pytest.fixture(scope="session")
def awkward(prose):
    """Rows that every operator must take: no text, no words, no ids, ties, repeated rows, a very long text."""
    long = prose(99, 30_000, 200)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "one"), (5, "one"), (6, prose(1, 60)), (7, prose(1, 60)), (7, prose(1, 60)),
        (8, "Ünï çødé \u00a0 wörds\u2003and 中文 text " * 5), (9, long), (None, "no id at all"), (10, "a\\b \"q\" 'x' {y} %s", None), (11, prose(2, 80), "t", None),
    ]
