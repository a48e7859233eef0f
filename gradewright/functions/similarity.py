"""Answer similarity.

The score is the Indel similarity 2*LCS/(len a + len b), also on whitespace
tokens in sorted order. Spark has no LCS expression, and nested higher-order
functions cost la*lb interpreted steps per pair, so the LCS runs in an Arrow
function with the bit-vector recurrence: one big-integer step per character,
whatever the length of the texts. Equal texts never reach Python, repeated pairs
of a batch are computed once, and when only the yes/no answer is needed the
length bound removes hopeless pairs as well.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.functions.space import SPACES, strip
from gradewright.functions.numeric import col_of, round_half_up
from gradewright.settings import DEFAULTS, Thresholds


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & positions.get(ch, 0)
        if hit:
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], int] = {}
    out: list[int | None] = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        pair = (x, y)
        if pair not in seen:
            seen[pair] = lcs_length(x, y)
        out.append(seen[pair])
    return pd.Series(out, dtype="Int32")


def normalised(text) -> Column:
    return strip(F.lower(F.coalesce(col_of(text), F.lit(""))))


def sorted_tokens(text) -> Column:
    tokens = F.filter(F.split(col_of(text), SPACES), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def _ratio(a: Column, b: Column, needed: Column | None = None) -> Column:
    """Indel similarity; the LCS is asked for only where it can matter."""
    size = F.length(a) + F.length(b)
    ask = a != b
    if needed is not None:
        ask = ask & needed
    common = _lcs(F.when(ask, a), F.when(ask, b))
    return F.when(a == b, F.lit(1.0)).otherwise(2.0 * common / F.nullif(size, F.lit(0)))


def similarity(predicted, expected, cfg: Thresholds = DEFAULTS, decide_only: bool = False) -> Column:
    """Unrounded similarity in [0, 1].

    With ``decide_only`` pairs that cannot reach the threshold give null instead
    of their exact value, and plain equality spares the token comparison.
    """
    a, b = normalised(predicted), normalised(expected)
    la, lb = F.length(a), F.length(b)
    both = (la > 0) & (lb > 0)

    def reachable(x: Column, y: Column) -> Column:
        shorter, total = F.least(F.length(x), F.length(y)), F.length(x) + F.length(y)
        return 2 * shorter >= F.lit(cfg.fuzzy_match) * total

    need = both & reachable(a, b) if decide_only else both
    plain = _ratio(a, b, need)
    best = plain
    if cfg.token_sort:
        ta, tb = sorted_tokens(a), sorted_tokens(b)
        # one token on either side and no inner whitespace: same strings, same ratio
        reordered = (ta != a) | (tb != b)
        need_tokens = both & (a != b) & reordered
        if decide_only:
            need_tokens = need_tokens & reachable(ta, tb)
        by_token = F.when(need_tokens, _ratio(ta, tb, need_tokens))
        best = F.greatest(plain, by_token)
    return (
        F.when((la == 0) & (lb == 0), F.lit(1.0)).when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(best)
    )


def is_fuzzy_match(sim: Column, cfg: Thresholds = DEFAULTS) -> Column:
    """The threshold is compared with the unrounded similarity."""
    return F.coalesce(sim >= F.lit(cfg.fuzzy_match), F.lit(False))


def rounded_similarity(sim: Column) -> Column:
    return round_half_up(sim, 4)


def agreement(first, second) -> Column:
    """How far two readers agree (plain ratio, no token order); a diagnostic."""
    raw_a = F.coalesce(col_of(first), F.lit(""))
    raw_b = F.coalesce(col_of(second), F.lit(""))
    a, b = normalised(raw_a), normalised(raw_b)
    return (
        F.when((raw_a == "") & (raw_b == ""), F.lit(1.0))
        .when((raw_a == "") | (raw_b == ""), F.lit(0.0))
        .otherwise(_ratio(a, b))
    )
