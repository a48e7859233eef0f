import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import pytest

from gradewright.llm import turn_repair as repair

SPACE = " \t\n\x0b\x0c\r"
TO = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def plain_script(turns):
    """Cheapest cost and first letters by recursion over all edits. ``turns``: (initial, must_go, truncated)."""

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(turns):
            if state in (0, 3):
                found.append((0, ""))
        else:
            initial, must_go, cut = turns[i]
            late = 3 * cut
            c, s = best(i + 1, state, 0)
            found.append((4 + c, "D" + s))
            if not must_go:
                if (state, initial) in KEEP:
                    c, s = best(i + 1, KEEP[state, initial], 0)
                    found.append((late + c, "K" + s))
                c, s = best(i + 1, TO[state], 0)
                found.append((3 + late + c, "R" + s))
        if inserts < 3:
            c, s = best(i, TO[state], inserts + 1)
            found.append((3 + c, "I" + s))
        return min(found, default=(10**9, "~"))

    return best(0, 0, 0)


def plain(rows):
    """The contract for damaged conversations. ``rows``: (conv_id, turn, role, text)."""
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        turns = []
        for c, turn, role, text in (r for r in rows if r[0] == conv):
            way = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if way == 1 else "".join(x for x in text if x not in ".!?") if way == 2 else text
            turns += [(turn is not None, turn or 0, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
        turns.sort()
        known = [t[1] for t in turns if t[0]]
        figures = dict(gaps=max(known) - min(known) + 1 - len(set(known)) if known else 0, blank=0, duplicate=0, truncated=0, illegal=0)
        seen, symbols = set(), []
        for *_, role, text in turns:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.strip(SPACE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                figures[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        figures["illegal"] = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit = plain_script(tuple(symbols))
        lines, state, i = [], 0, 0
        for letter in audit:
            role, text = turns[i][2:] if letter != "I" else ("", "")
            i += letter != "I"
            if letter == "K":
                state = KEEP[state, role[:1]]
                lines.append(f"{role}:{text}")
            elif letter in "RI":
                lines.append(f"{'assistant' if state == 2 else 'user'}:{text}")
                state = TO[state]
        out.append((conv, *figures.values(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = ["Hi.", "What?", "no stop", "", "  \t", "Yes!\n", "The same.", "The same.", "ünï.", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "usher", "", None]
    out = []
    for conv in range(220):
        n = r.randint(1, 14)
        tidy = r.random() < 0.5
        for turn in range(n):
            role = ("user", "assistant")[turn % 2] if tidy else r.choice(roles)
            out.append((conv, r.choice([turn, turn, turn * 2, None]), role, r.choice(texts)))
    out += [(None, 0, "user", "Hi."), (None, None, None, None), (-5, 2**62, "user", "Far."), (-5, -(2**62), "assistant", "Near.")]
    out += [(9000, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_equals_plain(spark, rows):
    got = repair.report(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    small = [r for r in rows if r[0] != 9000]
    found = {r.conv_id: r for r in got}
    assert len(found) == len(got) and 9000 in found
    for conv, *figures, audit, sha, _ in plain(small):
        r = found.pop(conv)
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256] == [*figures, audit, sha], conv
    assert list(found) == [9000] and found[9000].audit.count("K") > 2500


def test_repaired_turns_hash_alike(spark, rows):
    turns = repair.damaged(spark.createDataFrame(rows[:600], SCHEMA))
    scripts = repair.plans(turns)
    got = {}
    for r in sorted(repair.repaired(turns, scripts).collect(), key=lambda r: (str(r.conv_id), r.turn)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.turn == len(got[r.conv_id]) - 1
    want = {c: lines for c, *_, lines in plain(rows[:600]) if lines}
    convs = {c for c in want if c != rows[599][0]}
    assert {c: got[c] for c in convs} == {c: want[c] for c in convs}


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_of_any_length_trace_the_first_script(block):
    tables, r = repair.Tables(block), random.Random(block)
    kinds = [("s", False, False), ("u", False, False), ("a", False, False), ("t", False, False), ("u", False, True), ("a", False, True), ("s", False, True), ("x", False, True), ("u", True, False)]
    for _ in range(400):
        turns = tuple(r.choice(kinds) for _ in range(r.randint(0, 11)))
        assert tables.script(bytes(repair.symbol(*t) for t in turns)) == plain_script(turns)


def test_undamaged_conversations_extra_columns_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes.")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA + ", audit string, gone int")
    got = {r.conv_id: (r.cost, r.audit) for r in repair.digest(repair.whole(df)).collect()}
    assert got == {1: (0, "KK"), 2: (3, "IK")}
    assert repair.report(df).count() == 2
    assert repair.report(spark.createDataFrame([], SCHEMA)).count() == 0
