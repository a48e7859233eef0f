import random
import zlib

import pytest

from gradewright.llm import language_id as lid
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401

ALPHABETS = {"aa": "abcdeé", "bb": "cdefgü", "cc": "абвгд"}


def plain_profile(text):
    """Ranked grams, straight from the definition."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    n = {}
    for word in low.split():
        padded = f" {word} "
        for size in (1, 2, 3):
            for i in range(len(padded) - size + 1):
                gram = padded[i : i + size]
                if gram != " ":
                    n[gram] = n.get(gram, 0) + 1
    return sorted(n, key=lambda g: (-n[g], len(g), g))[: lid.PROFILE], n


def plain_distance(a, b):
    at = {g: i for i, g in enumerate(b)}
    return sum(abs(i - at[g]) if g in at else lid.PROFILE for i, g in enumerate(a))


def unpacked(code):
    out = ""
    while code:
        out, code = chr(code & (1 << lid.BITS) - 1) + out, code >> lid.BITS
    return out


def text_of(lang, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(5, 60)))


@pytest.fixture(scope="module")
def rows():
    return [(i, text_of(lang, i), "s", lang) for i, lang in enumerate(sorted(ALPHABETS) * 60)]


@pytest.mark.parametrize("text", ["", "  12 ", "a", "A  b-b\n", "Ünï ÇØDÉ ß中文 𝐀𝐛 a", "x" * 50, "ab " * 40 + "é", " lead and trail "])
@pytest.mark.parametrize("piece", [3, 7, 1 << 20])
def test_grams_equal_the_definition_in_pieces_of_any_size(text, piece, monkeypatch):
    monkeypatch.setattr(lid, "PIECE", piece)
    codes, counts = lid.grams(text, lid.letters())
    assert {unpacked(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == plain_profile(text)[1]
    assert [unpacked(int(c)) for c in lid.profile(text, lid.letters())] == plain_profile(text)[0]


def test_equals_plain_comparison(spark, frame, rows, awkward, monkeypatch):
    monkeypatch.setattr(lid, "BLOCK", 2)
    extra = [(r[0], r[1], "s", None) for r in awkward]
    got = lid.report(frame(rows + extra)).collect()
    assert len(got) == len(rows) + len(extra)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    known = {lang: plain_profile(" 1 ".join(t for i, t, _, of in rows if of == lang and not held(i)))[0] for lang in ALPHABETS}
    want = {}
    for i, text, *_ in rows + extra:
        mine = plain_profile(text or "")[0]
        if mine:
            far, lang = min((plain_distance(mine, p), lang) for lang, p in known.items())
            want[i, text] = (held(i), lang, 1 - far / (len(mine) * lid.PROFILE))
        else:
            want[i, text] = (held(i), "und", 0.0)
    for r, (i, text, *_) in zip(sorted(got, key=str), sorted(rows + extra, key=lambda x: str(x)), strict=False):
        assert 0 <= r.score <= 1
    found = sorted((str(r.doc_id), r.held_out, r.lang_pred, round(r.score, 12)) for r in got)
    assert found == sorted((str(i), *want[i, t][:2], round(want[i, t][2], 12)) for i, t, *_ in rows + extra)
    right = [r.lang_pred == rows[r.doc_id][3] for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(rows) and r.doc_id > 20]
    assert len(right) > 15 and all(right)


def test_sample_is_bounded_and_repeatable(frame, rows, monkeypatch):
    whole = lid.learn(frame(rows))
    assert whole == lid.learn(frame(rows[::-1]))
    monkeypatch.setattr(lid, "SAMPLE", 10)
    part = lid.learn(frame(rows))
    assert part == lid.learn(frame(rows[::-1])) and sorted(part) == sorted(whole) and part != whole


def test_nothing_to_learn_and_clashing_columns(frame, clashing):
    assert lid.report(frame([])).count() == 0
    got = lid.report(frame([(1, "a b", "s", None), (2, None, "s", "en"), (3, "12", "s", "en")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 3
    odd = clashing(frame([(1, "ab", "s", "x"), (3, "ab", "s", "")])).withColumnRenamed("n", "lang_pred").withColumnRenamed("distance", "row")
    out = lid.predict(odd, lid.learn(odd))
    assert set(out.columns) == set(odd.columns) and {r.lang_pred for r in out.collect()} == {""}
