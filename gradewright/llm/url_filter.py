"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts.

Hosts are nodes. An edge goes from a page's host to every host that its absolute links name, weighted by their number, and
between a host and the host above it (``a.b.example`` and ``b.example``; single labels are no hosts), since rules
hold for subdomains too. Trust starts at hosts with allowed pages and follows the edges; distrust starts at hosts with
blocked pages and follows them backwards, to those who link there. Both are personalised PageRank: at every step
a share ``DAMPING`` moves along the edges, the rest is renewed at the seeds; what reaches a host without further edges
ends there. A host is blocked if its settled distrust is above ``THRESHOLD`` times its settled trust by a share ``SAME`` of it.

Steps go on until no further step can change a verdict. After k steps a rank lies between its mass so far, m, and the lesser of two
bounds: m plus all that still moves, and m / (1 - k r), where r is the largest share by which the last step raised any host's mass (later
steps raise none by more: they are the same map applied to no more). When no new host was reached and the bounds decide every host, the verdicts are those of settled
ranks. Where bounds cannot part the two ranks of a host (near ties) steps end when no rank grows by more than a share ``SETTLED``.

Defined results: a null url, or one without ``://``, has an empty host and path and is no node; a null html has no links; repeated
rows are repeated links; a host that neither reaches is allowed; extra columns pass through, but host, path, rule and
verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import keep, lower_ascii, small

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
DAMPING, STEPS, THRESHOLD = 0.85, 12, 1.0  # STEPS: of ``ranks`` unless it is to settle
SETTLED, SAME = 1e-8, 1e-6
LEAST = 1e-300  # growth that counts; below, doubles lose their digits
WRITTEN = 8  # steps per written table
BROADCAST_HOSTS = 1_000_000  # blocked hosts that are sent to every task
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]*)"""
TWIN_STEPS = 160  # of the SQL twin: 0.85**160 is 5e-12


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits ``host`` and ``path``."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r)):
        name, start = r.split("/", 1)
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{start}")
        out = F.when(fits, r).otherwise(out)
    return out


def ruled(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``by_rule``."""
    out = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("rule", rule(rules))
    verdict = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    return out.withColumn("by_rule", F.when(F.col("rule").isNotNull(), F.element_at(verdict, F.col("rule"))))


def edges(pages: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``weight`` between different hosts. Links are counted before they are shuffled."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    links = found.select("src", host(F.concat(F.lit("http:"), F.regexp_extract("link", "(?s)(//.*)$", 1))).alias("dst"))
    links = links.where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    named = pages.where("host <> ''").select("host").distinct().unionByName(links.select(F.col("dst").alias("host")))
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = (
        named.where("host LIKE '%.%.%'")
        .select(chain.alias("c"))
        .select(F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("low"), F.slice("c", 2, F.size("c") - 1).alias("high"))).alias("e"))
        .select("e.*")
        .distinct()
    )
    tied = [above.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(1.0).alias("weight")) for a, b in (("low", "high"), ("high", "low"))]
    return links.unionByName(tied[0]).unionByName(tied[1]).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def ranks(graph: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int | None = STEPS, apart: float | None = None) -> DataFrame:
    """``host``, ``trust``, ``distrust`` from ``seeds`` (kind, host, mass of 1 for each kind), after so many steps, or with
    None when all ranks have settled, or, with ``apart``, when it is sure for every host whether its distrust is above ``apart`` times its
    trust; ``untrusted`` where no trust arrives, as far-off ranks can be too small for a double.

    ``mass`` is what has come to rest by now, ``term`` the part of it that the last step added. A host's ``term`` against its mass
    of the step before is at most the largest such share of the hosts it comes from, so that share never rises again."""
    both = graph.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        graph.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    shares = both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out") * damping).alias("share"))
    # every host keeps its own mass by an edge without a share to itself, so that a step reads the ranks once
    nodes = seeds.select("kind", "host").unionByName(both.select("kind", F.explode(F.array("src", "dst")).alias("host"))).distinct()
    own = nodes.select("kind", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("share"))
    steps_of = keep(shares.unionByName(own), "link-shares")
    rest = F.col("mass") * (1 - damping)
    now, step, reached, sure = seeds.select("kind", "host", rest.alias("mass"), rest.alias("term")), 0, -1, False
    while steps is None or step < steps:
        added = F.coalesce(F.col("term") * F.col("share"), F.lit(0.0))
        moved = now.join(steps_of, ["kind", "host"]).select("kind", F.col("dst").alias("host"), F.when(F.col("share").isNull(), F.col("mass")).otherwise(added).alias("mass"), added.alias("term"))
        now = moved.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("term").alias("term"))
        step += 1
        if step % WRITTEN == 0 or step == steps:
            now = keep(now, "link-ranks")
            if steps is None:
                before = F.col("mass") - F.col("term")
                share = F.when(before > 0, F.try_divide(F.col("term"), before)).otherwise(float("inf"))  # newly reached
                grown = F.when(F.col("term") > LEAST, share)
                moving = F.sum("term") * (damping / (1 - damping))
                found = now.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.max(grown), F.lit(0.0)).alias("grown"), moving.alias("moving")).collect()  # two rows
                hosts, growing = sum(r["n"] for r in found), max((r["grown"] for r in found), default=0.0)
                if hosts == reached:
                    sure = apart is not None and not undecided(now, {r["kind"]: (r["moving"], step * r["grown"]) for r in found}, apart)
                    if sure or growing <= SETTLED:
                        break
                reached = hosts
    # what still moves is counted where it is; where verdicts are sure they hold for the masses as they are
    mass = F.col("mass") if sure else F.col("mass") + F.col("term") * (damping / (1 - damping))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, mass)), F.lit(0.0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"), (F.max("kind") == "distrust").alias("untrusted"))


def undecided(now: DataFrame, bounds: dict[str, tuple[float, float]], apart: float) -> bool:
    """Whether, for a host that both kinds reach, further steps could bring distrust above ``apart`` times trust or below it. ``bounds``: for each
    kind what still moves, and the share by which ranks can still grow."""
    if len(bounds) < 2:
        return False
    most = F.lit(None).cast("double")
    for kind, (moving, share) in bounds.items():
        up = F.col("mass") + moving
        most = F.when(F.col("kind") == kind, F.least(up, F.col("mass") / (1 - share)) if share < 1 else up).otherwise(most)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    low = {k: of(k, "mass") for k in ("trust", "distrust")}
    high = {k: of(k, "most") for k in ("trust", "distrust")}
    open_ = (low["distrust"] <= apart * high["trust"]) & (high["distrust"] > apart * low["trust"])
    return now.withColumn("most", most).groupBy("host").agg(F.coalesce(open_, F.lit(False)).alias("open")).where("open").limit(1).count() > 0


def judge(pages: DataFrame, rules: dict[str, str] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` and ``verdict``."""
    rest = [f"page.{c}" for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    known = ruled(pages.select(F.struct("*").alias("page"), "url", "html"), rules)
    votes = known.where("host <> '' AND by_rule IS NOT NULL").groupBy("by_rule", "host").agg(F.count("*").alias("n"))
    totals = votes.groupBy("by_rule").agg(F.sum("n").alias("total"))
    kind = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind")
    seeds = keep(votes.join(totals, "by_rule").select(kind, "host", (F.col("n") / F.col("total")).alias("mass")), "link-seeds")
    apart = threshold * (1 + SAME)
    found = ranks(edges(known), seeds, steps=None, apart=apart)
    bad = keep(found.where(F.col("untrusted") | (F.col("distrust") > apart * F.col("trust"))).select(F.col("host").alias("bad")), "link-blocked")
    verdict = F.coalesce("by_rule", F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    out = known.drop("url", "html").join(small(bad, bad.count(), BROADCAST_HOSTS), F.col("host") == F.col("bad"), "left")
    return out.select(*rest, "host", "path", "rule", verdict.alias("verdict"))


def report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")
