"""Reuse of identical requests for a limited time.

A request is executed unless an answer to the same request is younger than ``ttl``. Which ones are is a chain from the first on, each
answered request deciding the next. It is found without walking a key's requests in one task:

* A pause of ``ttl`` between two answers cuts the chain whatever came before: what follows a pause is a *head*, and executed.
* Every request has a fixed *next* one, the first that succeeds ``ttl`` later or more. Time is cut into slots of ``ttl``, so that next lies in
  the next slot, or is the first of the one after.
* Slots are joined two by two into chunks of 1, 2, 4 .. slots. For the requests by which a chain can enter a chunk (those of its first slot, and
  the first of its second), the *exit* is composed from the exits of both halves. Each level has about half the rows of the level below.
* Heads climb: from chunk to chunk while they leave right halves, until nothing is left to leave. Then the entries of both halves are
  marked, level by level downwards. The marks of the single slots are the answered requests.

Every step is a join on (request, time), so a request with a third of all rows and no pause is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.operators.running import Measure, running
from gradewright.session import keep
from gradewright.settings import DEFAULTS, Thresholds

SPARSE = {"bits": 22, "levels": 2}  # times in microseconds: chunks of four seconds, and of half a year
def _pointers(good: DataFrame, ttl: int) -> DataFrame:
    """Successes (k, t) with their slot, whether they are a head or the first of their slot, and ``nxt`` with its slot. A next request
    that is a head needs no pointer."""
    near = running(good, "t", [Measure("before", "last", F.col("t"), inclusive=False)], ["k"], **SPARSE)
    slot, old = F.expr(f"t div {ttl}"), F.expr(f"before div {ttl}")
    head = F.col("before").isNull() | (F.col("t") - F.col("before") >= ttl)
    nodes = keep(near.select("k", "t", slot.alias("s"), head.alias("head"), (head | (old < slot)).alias("first")), "request-nodes")
    # a request stands behind the question for it at the same time
    asked = nodes.select("k", (2 * (F.col("t") + ttl)).alias("o"), F.struct("t", "s", "head", "first").alias("of"))
    there = nodes.select("k", (2 * F.col("t") + 1).alias("o"), F.struct("t", "s", "head").alias("hit"))
    both = asked.unionByName(there, allowMissingColumns=True)
    found = running(both, "o", [Measure("next", "last", F.col("hit"), backward=True)], ["k"], SPARSE["bits"] + 1, SPARSE["levels"])
    goes = ~F.col("next.head")
    return found.where("of IS NOT NULL").select(
        "k", "of.*", F.when(goes, F.col("next.t")).alias("nxt"), F.when(goes, F.col("next.s")).alias("nxt_s")
    )


def _chunk(slot: Column, level: int) -> Column:
    return F.shiftright(slot, level)


def _right(slot: Column, level: int) -> Column:
    """Whether a chunk of this level is the right half of the next one."""
    return _chunk(slot, level) % 2 == 1


def _enters(level: int) -> Column:
    at = F.col("s") % (1 << level)
    return (at == 0) | ((at == 1) & F.col("first")) if level else F.lit(True)


def _hops(level: int) -> Column:
    """Whether a climbing request leaves its chunk: it is in a right half and no entry of the whole."""
    at = _right(F.col("s"), level)
    return at & ~F.col("first") if level == 0 else at


def _exits(low: DataFrame, level: int) -> DataFrame:
    """Exits of the chunks of ``level`` + 1 from those of ``level``."""
    inside = (_chunk(F.col("nxt_s"), level) == _chunk(F.col("s"), level) + 1) & ~_right(F.col("s"), level)
    via = low.select("k", F.col("t").alias("nxt"), F.col("nxt").alias("far"), F.col("nxt_s").alias("far_s"))
    entries = low.where(_enters(level + 1))
    crossing = entries.where(F.coalesce(inside, F.lit(False))).join(via, ["k", "nxt"])
    rest = entries.where(~F.coalesce(inside, F.lit(False)))
    return rest.unionByName(crossing.select("k", "t", "s", "head", "first", F.col("far").alias("nxt"), F.col("far_s").alias("nxt_s")))


def _answered(good: DataFrame, ttl: int) -> DataFrame:
    """The successes (k, t) that are executed."""
    start = good.agg(F.coalesce(F.min("t"), F.lit(0))).first()[0]  # one value; slots are counted from the first request
    zero = start // ttl * ttl
    exits = [keep(_pointers(good.withColumn("t", F.col("t") - zero), ttl), "request-exits")]
    columns = ["k", "t", "s", "first"]
    climbing = [exits[0].where("head").select(*columns)]
    while True:
        level, low = len(exits) - 1, exits[-1]
        if not low.where("nxt IS NOT NULL").limit(1).count():
            break
        steps = low.select("k", "t", "nxt", "nxt_s")
        moved = climbing[-1].join(steps, ["k", "t"]).withColumn("_hop", _hops(level)).where("NOT _hop OR nxt IS NOT NULL")
        up = moved.select(
            "k", F.when(F.col("_hop"), F.col("nxt")).otherwise(F.col("t")).alias("t"),
            F.when(F.col("_hop"), F.col("nxt_s")).otherwise(F.col("s")).alias("s"),
            F.when(F.col("_hop"), F.lit(True)).otherwise(F.col("first")).alias("first"),
        )
        climbing.append(keep(up, "request-climbing"))
        exits.append(keep(_exits(low, level), "request-exits"))
    marked = climbing[-1]
    for level in range(len(exits) - 2, -1, -1):
        steps = exits[level].select("k", "t", "nxt", "nxt_s")
        sibling = ~_right(F.col("s"), level) & (_chunk(F.col("nxt_s"), level) == _chunk(F.col("s"), level) + 1)
        own, other = F.struct(*columns), F.struct("k", F.col("nxt").alias("t"), F.col("nxt_s").alias("s"), F.lit(True).alias("first"))
        both = F.when(F.coalesce(sibling, F.lit(False)), F.array(own, other)).otherwise(F.array(own))
        marked = marked.join(steps, ["k", "t"]).select(F.explode(both).alias("m")).select("m.*")
        marked = marked.unionByName(climbing[level].where(_hops(level)))
    return marked.select("k", (F.col("t") + zero).alias("t"))


def fresh_requests(
    requests: DataFrame,
    key: str = "fingerprint",
    ts: str = "ts",
    failed: str | None = None,
    cfg: Thresholds = DEFAULTS,
) -> DataFrame:
    """Requests that are really executed: the first of each fingerprint, then the
    first one at least ``ttl`` after the last answered one, and so on. A failed
    request is not kept for reuse. Simultaneous repeats count as one; if one of
    them succeeds, the instant counts as answered.
    """
    ttl = cfg.request_ttl_seconds * 1_000_000
    fail = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    instants = requests.groupBy(F.struct(F.col(key)).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).agg(
        F.bool_and(fail).alias("failed")
    )
    if ttl <= 0:
        return instants.select(F.col(f"k.{key}").alias(key), F.timestamp_micros("t").alias(ts))
    instants = keep(instants, "request-instants")
    run = answered = _answered(instants.where("NOT failed").select("k", "t"), ttl)
    if failed:
        answered = keep(answered, "request-answered")
        tries = instants.where("failed").select("k", "t", F.lit(None).cast("bigint").alias("done"))
        line = tries.unionByName(answered.select("k", "t", F.col("t").alias("done")))
        near = running(line, "t", [Measure("last", "last", F.col("done"))], ["k"], **SPARSE)
        run = near.where("done IS NOT NULL OR last IS NULL OR t - last >= " + str(ttl)).select("k", "t")
    return run.select(F.col(f"k.{key}").alias(key), F.timestamp_micros("t").alias(ts))
