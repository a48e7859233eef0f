import random

import pytest

from gradewright.llm import url_filter
from llm_fixtures import clashing  # noqa: F401

SCHEMA = "page_id long, url string, html string"


def rank(edges, seeds, damping=url_filter.DAMPING, steps=url_filter.STEPS):
    out = {}
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0) + w
    now = dict(seeds)
    for _ in range(steps):
        new = {h: m * (1 - damping) for h, m in seeds.items()}
        for (a, b), w in edges.items():
            if a in now:
                new[b] = new.get(b, 0) + now[a] * damping * w / out[a]
        now = new
    return now


def test_hosts_paths_and_rules(spark):
    urls = {
        "https://A.Example.ORG/es/x?q#f": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/19#t": ("example.org", "/en/19", "example.org/en/1", "block"),
        "http://example.org/de/1": ("example.org", "/de/1", "org/", "allow"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/1?a": ("x.com", "/de/1", "com/de/", "block"),
        "http://xorg": ("xorg", "", None, "allow"),
        "http://y.org": ("y.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://a://b/c": ("a:", "//b/c", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.report(df).collect()}
    assert got == {i: v for i, v in enumerate(urls.values())}


def test_rank_equals_plain_iteration(spark):
    edges = {("a", "b"): 2.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("b", "d"): 3.0, ("e", "b"): 1.0}
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "d", 1.0)], "kind string, host string, mass double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.ranks(graph, seeds).collect()}
    trust, bad = rank(edges, {"a": 1.0}), rank({(b, a): w for (a, b), w in edges.items()}, {"d": 1.0})
    for h in set(trust) | set(bad):
        assert got[h] == pytest.approx((trust.get(h, 0), bad.get(h, 0)))


def test_links_carry_distrust_back_and_trust_on(spark, clashing):
    bad = '<a href="https://bad.com/de/1">x</a> <A class=z HREF=\'//BAD.com/q\'>y</A>'
    good = '<a href="http://friend.net/">x</a><a href="/local">l</a>'
    rows = [(1, "http://bad.com/de/9", ""), (2, "http://shill.net/a", bad), (3, "http://ok.org/a", good), (4, "http://friend.net/b", None), (4, "http://friend.net/b", None)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    got = url_filter.judge(df)
    assert {(r.page_id, r.verdict) for r in got.collect()} == {(1, "block"), (2, "block"), (3, "allow"), (4, "allow")} and got.count() == 5
    assert set(df.columns) <= set(got.columns)


def test_empty_table(spark):
    assert url_filter.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distrust_reaches_any_distance_however_small(spark):
    """20 hosts in a row that link on to a blocked one; most links to each come from another host, so ranks fall below 1e-30."""
    many = lambda h: f'<a href="http://{h}/">x</a>' * 30
    hosts = [f"h{i}.net" for i in range(20)] + ["bad.com"]
    rows = [(i, f"http://{a}/", f'<a href="http://{b}/de/1">x</a>') for i, (a, b) in enumerate(zip(hosts, hosts[1:]))]
    rows += [(20, "http://bad.com/de/1", None), (21, "http://far.net/", None), (22, "http://spam.net/", "".join(map(many, hosts)))]
    got = {r.page_id: r.verdict for r in url_filter.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: "allow" if i == 21 else "block" for i in range(23)}


def test_two_way_chain_equals_converged_ranks(spark):
    n = 12
    edges = {(a, b): 1.0 for i in range(n - 1) for a, b in ((f"{i:02}", f"{i + 1:02}"), (f"{i + 1:02}", f"{i:02}"))}
    graph = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("trust", "00", 1.0), ("distrust", f"{n - 1:02}", 1.0)], "kind string, host string, mass double")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.ranks(graph, seeds, steps=None).collect()}
    trust, bad = rank(edges, {"00": 1.0}, steps=400), rank({(b, a): w for (a, b), w in edges.items()}, {f"{n - 1:02}": 1.0}, steps=400)
    assert got == {h: pytest.approx((trust[h], bad[h]), rel=1e-6) for h in trust}
    assert [h for h, (t, d) in sorted(got.items()) if d > t * (1 + url_filter.SAME)] == [f"{i:02}" for i in range(n // 2, n)]


def test_sure_verdicts_equal_settled_ones(spark):
    """Steps that end when bounds decide give the verdicts of settled ranks, on random graphs and on hosts far from all seeds."""
    r = random.Random(6)
    for n in (6, 12, 25):
        names = [f"h{i:02}" for i in range(n)]
        edges = {(a, b): float(r.randint(1, 5)) for a in names for b in r.sample(names, min(n, 3)) if a != b}
        edges |= {(f"c{i}", f"c{i + 1}"): 1.0 for i in range(15)} | {(f"c{i + 1}", f"c{i}"): 2.0 for i in range(15)} | {("c0", "h00"): 1.0, ("h00", "c0"): 1.0}
        graph = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double")
        seeds = spark.createDataFrame([("trust", "h00", 0.5), ("trust", "h01", 0.5), ("distrust", "h03", 0.7), ("distrust", "h01", 0.3)], "kind string, host string, mass double")
        apart = 1 + url_filter.SAME
        early = {x.host: x.untrusted or x.distrust > apart * x.trust for x in url_filter.ranks(graph, seeds, steps=None, apart=apart).collect()}
        trust = rank(edges, {"h00": 0.5, "h01": 0.5}, steps=500)
        bad = rank({(b, a): w for (a, b), w in edges.items()}, {"h03": 0.7, "h01": 0.3}, steps=500)
        assert early == {h: bad.get(h, 0.0) > apart * trust.get(h, 0.0) for h in set(trust) | set(bad)}


def test_twin_equals_the_operator_on_linked_pages(spark, tmp_path):
    import duckdb

    from gradewright.llm.oracle import SQL

    r, rows = random.Random(9), []
    hosts = [f"{a}.example.{t}" for t in ("org", "com", "net") for a in ("x", "y", "www.z", "w")] + ["bad.com", "good.org", "lone.net"]
    for i in range(200):
        links = "".join(f'<a href="http://{r.choice(hosts)}/fr/x">l</a>' for _ in range(r.randint(0, 4)))
        rows.append((i, f"http://{r.choice(hosts)}/{r.choice(['de', 'fr', 'en', 'es'])}/{r.randint(1, 30)}", links if i % 9 else None))
    df = spark.createDataFrame(rows, SCHEMA)
    df.toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({SQL['op4_url_filter']})").fetchall())
    assert sorted(map(tuple, url_filter.report(df).collect())) == want
    assert len({v[4] for v in want}) == 2


def test_columns_of_any_name_pass_through(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/1", None, "b", "r", "p", "h")], SCHEMA + ", bad string, by_rule string, page string, _bad string")
    (row,) = url_filter.judge(df).collect()
    assert (row.bad, row.by_rule, row.page, row["_bad"], row.verdict) == ("b", "r", "p", "h", "block")
