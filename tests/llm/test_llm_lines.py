import random
from collections import Counter

import brute
from gradewright.llm import line_dedup
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401


def expected(rows):
    """{(doc_id, line_no): (class doc_id, class line, kept)} from all pairs of token sets."""
    lines = [(-1 if i is None else i, k, frozenset(brute.WORD.findall(line))) for i, t in rows if t is not None for k, line in enumerate(t.split("\n")) if brute.WORD.search(line)]
    lines.sort(key=lambda x: x[:2])
    first = {}
    for i, k, s in lines:
        first.setdefault(s, (i, k))
    links = {s: [o for o in first if o != s and 4 * len(s & o) >= 3 * len(s | o)] for s in first}
    return Counter((i, k, *first[s], (i, k) == first[s] and all(first[o] > first[s] for o in links[s])) for i, k, s in lines)


def result(df):
    return Counter(tuple(-1 if v is None else v for v in r) for r in line_dedup.judge(df).collect())


def variants(prose):
    """Lines that share nearly all words with earlier ones, at, above and below the bound."""
    words = prose(7, 40, 1).split()
    out = ["a b c", "a b c d", "a b c d e f", "d c b a", "the", "the the", "of the"]
    for k in range(0, 12):
        out.append(" ".join(words[k:]))
        out.append(" ".join(words[: 40 - k] + [f"new{k}x{i}" for i in range(k)]))
    return out


def test_equals_all_pairs(frame, prose, awkward):
    rows = [(20 + i, f"{v}\n\n{prose(i % 4, 30)}\n{v}") for i, v in enumerate(variants(prose))]
    rows += [(r[0], r[1]) for r in awkward if r[0] not in (5, 7, 9)]
    assert result(frame(rows)) == expected(rows)


def test_repeated_rows_and_very_long_texts(frame, awkward):
    got = line_dedup.judge(frame([r for r in awkward if r[0] in (5, 7, 9, 6)]))
    kept = Counter((r.doc_id, r.line_no) for r in got.where("kept").collect())
    assert kept[(7, 0)] == 0 and kept[(6, 0)] == 1 and kept[(9, 0)] == 1
    assert sum(n for (i, _), n in kept.items() if i == 5) == 2  # rows alike in id and place are one place


def test_clean_removes_later_lines_only(frame, clashing):
    df = clashing(frame([(1, "a b c d\nkeep me"), (2, "x y z\nd c b a\n\nlast"), (3, None)]))
    out = line_dedup.clean(df)
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a b c d\nkeep me", 15), 2: ("x y z\n\nlast", 11), 3: (None, None)}


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "a b\na b", "x", "y")], "doc_id long, text string, _id string, _gone string")
    assert [tuple(r) for r in line_dedup.clean(df).collect()] == [(1, "a b", "x", "y")]


def test_empty_table(frame):
    assert line_dedup.judge(frame([])).count() == 0


def test_every_link_of_a_group_counts(frame, prose):
    """Near copies that differ in one word: every pair of classes is linked, not only each with the earliest."""
    words = prose(3, 20, 1).split()
    group = [" ".join(words + [f"own{i}"]) for i in range(8)]
    rows = [(i, f"{line}\n{prose(50 + i, 30, 1)}") for i, line in enumerate(group)] + [(9, group[0]), (9, group[0])]
    got = Counter((r.doc_id, r.line_no, r.n_links, r.kept) for r in line_dedup.judge(frame(rows), n_links=True).collect())
    assert got == Counter([*((i, 0, 7, i == 0) for i in range(8)), *((i, 1, 0, True) for i in range(8)), (9, 0, 7, False), (9, 0, 7, False)])


def test_link_counts_equal_all_pairs(frame, prose, awkward):
    rows = [(20 + i, v) for i, v in enumerate(variants(prose))] + [(r[0], r[1]) for r in awkward if r[0] not in (5, 7, 9)]
    sets = {frozenset(brute.WORD.findall(line)) for _, t in rows if t for line in t.split("\n") if brute.WORD.search(line)}
    texts = {(-1 if i is None else i): t for i, t in rows}
    for r in line_dedup.judge(frame(rows), n_links=True).collect():
        s = frozenset(brute.WORD.findall(texts[-1 if r.doc_id is None else r.doc_id].split("\n")[r.line_no]))
        assert r.n_links == sum(o != s and 4 * len(s & o) >= 3 * len(s | o) for o in sets)


def test_classes_of_a_code_meet_without_a_window(frame):
    _, sets = line_dedup.classes(frame([(i, f"the same words but {i}") for i in range(5)]))
    plan = line_dedup.candidates(sets)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join Inner" in plan


def test_large_sets_that_share_a_few_rare_words_are_no_candidates(frame):
    r = random.Random(4)
    common = [f"w{i}" for i in range(600)]
    line = lambda pair: " ".join(r.sample(common, 115) + [f"rare{pair}x{k}" for k in range(5)])
    _, sets = line_dedup.classes(frame([(i, line(i // 2)) for i in range(40)]))
    assert line_dedup.candidates(sets).count() == 0


def test_rows_of_one_id_with_other_texts_are_linked(frame):
    got = line_dedup.judge(frame([(1, "a b c d e f g h"), (1, "a b c d e f g i"), (2, "a b c d e f g j")]), n_links=True)
    assert sorted((r.doc_id, r.n_links) for r in got.collect()) == [(1, 2), (1, 2), (2, 2)]


def test_crowded_cells_are_split(frame, prose, monkeypatch):
    monkeypatch.setattr(line_dedup, "CELL_PAIRS", 3)
    words = prose(3, 20, 1).split()
    rows = [(i, " ".join(words + [f"own{i}"])) for i in range(12)]
    assert {r.n_links for r in line_dedup.judge(frame(rows), n_links=True).collect()} == {11}
    _, sets = line_dedup.classes(frame(rows))
    sizes = [r["count"] for r in line_dedup.cells(line_dedup.candidates(sets)).groupBy("cell").count().collect()]
    assert sum(sizes) == 66 and len(sizes) > 10


def family(prose, seed, size):
    """Near copies of one line: words left out, put in, and put in by several."""
    r = random.Random(seed)
    words = prose(seed, 60, 1).split()
    out = []
    for i in range(size):
        line = [w for w in words if r.random() > 0.05] + [f"s{seed}x{r.randrange(6)}" for _ in range(r.randrange(5))] + [f"s{seed}own{i}x{k}" for k in range(r.randrange(4))]
        r.shuffle(line)
        out.append(" ".join(line))
    return out


def test_links_in_large_groups_of_near_copies_equal_all_pairs(frame, prose):
    said = [line for seed, size in ((11, 70), (12, 45), (13, 17)) for line in family(prose, seed, size)] + [" ".join(prose(11, 60, 1).split()[k:]) for k in range(20)]
    random.Random(1).shuffle(said)
    rows = [(i, f"{line}\n{prose(500 + i, 12, 1)}") for i, line in enumerate(said)] + [(999, said[3]), (999, said[3])]
    sets = sorted({frozenset(line.split()): i for i, line in reversed(list(enumerate(said)))}.items(), key=lambda x: x[1])
    linked = {s: [o for o, _ in sets if o != s and 4 * len(s & o) >= 3 * len(s | o)] for s, _ in sets}
    first = dict(sets)
    for r in line_dedup.judge(frame(rows), n_links=True).where("line_no = 0").collect():
        s = frozenset(said[3 if r.doc_id == 999 else r.doc_id].split())
        assert (r.n_links, r.class_doc_id) == (len(linked[s]), first[s])
        assert r.kept == (r.doc_id == first[s] and all(first[o] > first[s] for o in linked[s]))


def test_links_of_a_large_group_are_not_met_pair_by_pair(frame, prose):
    rows = [(i, line) for i, line in enumerate(family(prose, 21, 150))]
    docs = frame(rows)
    _, sets = line_dedup.classes(docs)
    members = line_dedup.around(docs, sets)
    pairs = line_dedup.candidates(sets.join(members.select("id", "near"), "id", "left")).count() + line_dedup.unsure(members).count()
    links = sum(r.n_links for r in line_dedup.judge(docs, n_links=True).collect()) // 2
    assert links > 5000 and pairs < links / 5
