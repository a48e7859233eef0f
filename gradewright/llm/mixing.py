"""Mixing sources to target weights by subset-sum budget fitting.

Every source takes whole rounds of its documents while they fit its target. For what remains of the target, the
documents are counted by exact word length; each length gives its proportional share of documents, and a bounded
knapsack over the lengths fills the rest, exactly where a subset of lengths does; where very long
documents leave a rest open, the longest are given back and their room is filled anew, in a coarser unit first. Within a length the documents
with the lowest seeded draws are taken, so reruns and other partitionings agree.

Defined results: a null text has size 0; a document without words is never taken; null is a source of its own, the
last; rows alike in doc_id and text share one draw and are taken alike; an empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.common import BLANKS, keep, pieces, small, uniform

WEIGHTS = (1.0, 2.0, 3.0)  # of the sources by code point, repeating
MOST = 3  # times a document, and a source, is taken at most
FIT_WORDS = 1 << 17  # words that the knapsack fills; shares by length come this near first
GIVE_BACK = 16  # times the longest document, the room that is filled anew where the first choice leaves some open
BLOCK = 65_536  # draws of one length that one window orders
BROADCAST_CUTS = 400_000  # rows of the plan by source and length (40 bytes each) sent to all tasks


def size(text: Column) -> Column:
    return F.size(pieces(text, BLANKS)).cast("long")


def seeded(seed: str) -> Column:
    return uniform(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))


def targets(by_source: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From ``source``, ``source_size``: adds ``target``. The total of all sizes is shared by weight; targets stop at
    ``most`` times their source's size, and the others share what is left. One row per source, so the windows
    run over the list of sources, not over documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # sources in the order in which they fill up; a source is full if its limit is below its share of what is left
    full = ranked.withColumn("full", most * F.col("source_size") <= F.col("weight") * left / weight_left)
    spare = F.sum("source_size").over(every) - most * F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every)
    heavy = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    share = F.col("weight") * spare / F.nullif(heavy, F.lit(0.0))
    return full.withColumn("target", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share)).drop("full", "weight")


def fill(lengths: np.ndarray, left: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: how many of each length to take so that their sum is as near below ``budget`` as it can be."""
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    via = np.full(budget + 1, -1, np.int32)
    parts: list[tuple[int, int]] = []  # (index of the length, copies), copies by binary splitting
    for i in range(len(lengths)):
        room, copies = min(int(left[i]), budget // int(lengths[i])), 1
        while room > 0 and not reached[budget]:
            copies = min(copies, room)
            step = copies * int(lengths[i])
            new = reached[:-step] & ~reached[step:]
            via[step:][new] = len(parts)
            reached[step:] |= new
            parts.append((i, copies))
            room, copies = room - copies, copies * 2
        if reached[budget]:
            break
    taken, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        i, copies = parts[via[at]]
        taken[i] += copies
        at -= copies * int(lengths[i])
    return taken


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length have ``budget`` words together: shares by length, the knapsack for the rest."""
    total = int((lengths * counts).sum())
    if 2 * budget > total:  # choosing what stays out has more documents to choose from
        return counts - choose(lengths, counts, total - budget, fit_words)
    extra = (counts * (budget / total)).astype(np.int64)
    left, rest = counts - extra, budget - int((lengths * extra).sum())
    for i in np.argsort(-lengths):  # shares are rounded down; long documents bring the rest below what the knapsack fills
        if rest <= fit_words:
            break
        more = min(int(left[i]), (rest - fit_words // 2) // int(lengths[i]))
        if more > 0:
            extra[i] += more
            left[i] -= more
            rest -= more * int(lengths[i])
    if 0 < rest <= fit_words:
        extra += fill(lengths, left, rest)
    rest = budget - int((lengths * extra).sum())
    return extra if rest == 0 else refill(lengths, counts, extra, rest, fit_words)


def refill(lengths: np.ndarray, counts: np.ndarray, extra: np.ndarray, rest: int, fit_words: int) -> np.ndarray:
    """A choice that leaves less open than ``extra``, as very long documents do, or ``extra`` itself. Its longest documents are
    given back and their room is filled by the knapsack in a coarser unit, then in words."""
    again, room, wide = extra.copy(), rest, GIVE_BACK * int(lengths.max())
    for i in np.argsort(-lengths):
        back = max(0, min(int(again[i]), -(-(wide - room) // int(lengths[i]))))
        again[i] -= back
        room += back * int(lengths[i])
    unit = -(-room // fit_words)
    again += fill(-(-lengths // unit), counts - again, room // unit)  # lengths rounded up, so that none goes beyond
    room = rest + int((lengths * (extra - again)).sum())
    if room > fit_words:
        for i in np.argsort(-lengths):  # what rounding left open
            more = min(int(counts[i] - again[i]), room // int(lengths[i]))
            again[i] += more
            room -= more * int(lengths[i])
    if 0 < room <= fit_words:
        again += fill(lengths, counts - again, room)
    return again if (lengths * again).sum() > (lengths * extra).sum() else extra


def fit(lengths: np.ndarray, counts: np.ndarray, target: float, most: int = MOST) -> tuple[int, np.ndarray]:
    """Whole rounds, and how many documents of each length one time more."""
    total = int((lengths * counts).sum())
    rounds = min(most, int(target // total)) if total else 0
    budget = int(round(target)) - rounds * total
    if budget <= 0 or rounds >= most:
        return rounds, np.zeros(len(lengths), np.int64)
    return rounds, choose(lengths, counts, budget)


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's lengths: a row for each, at most as many as the longest document has words."""
    rows = rows.sort_values("size")
    lengths, counts = rows["size"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)
    rounds, extra = fit(lengths, counts, float(rows["target"].iloc[0]))
    return pd.DataFrame({"source": rows["source"], "size": lengths, "count": counts, "rounds": rounds, "extra": extra})


def plan(docs: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """By source its size and target; by source and length the whole rounds and the highest draw taken once more."""
    narrow = keep(docs.select("source", size(F.col("text")).alias("size"), seeded(seed).alias("draw")), "mix-sizes")
    lengths = keep(narrow.groupBy("source", "size").count(), "mix-lengths")
    goal = keep(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))), "mix-targets")
    known = goal.withColumnRenamed("source", "s")
    with_goal = lengths.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("s")))
    fitted = keep(
        with_goal.select("source", "size", "count", "target")
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, size long, count long, rounds long, extra long"),
        "mix-fit",
    )
    some = fitted.where("extra > 0").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "extra", F.ceil(F.col("count") / BLOCK).alias("blocks")
    )
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    drawn = narrow.join(some, same).select("source", "size", "draw", "extra", F.floor(F.col("draw") * F.col("blocks")).alias("block"))
    # the draws of a length lie in blocks by value; the wanted one is in the block where the running count passes it
    upto = F.sum("count").over(Window.partitionBy("source", "size").orderBy("block"))
    at = (
        drawn.groupBy("source", "size", "extra", "block").count().withColumn("upto", upto)
        .where((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("count") < F.col("extra")))
        .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("block").alias("b"), (F.col("extra") - F.col("upto") + F.col("count")).alias("nth"))
    )
    cut = (
        drawn.join(at, same & (F.col("block") == F.col("b")))
        .withColumn("n", F.row_number().over(Window.partitionBy("source", "size").orderBy("draw")))
        .where("n = nth")
        .select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("draw").alias("cut"))
    )
    cuts = keep(fitted.join(cut, same, "left").select("source", "size", "rounds", F.coalesce("cut", F.lit(-1.0)).alias("cut")), "mix-cuts")
    return goal, cuts


def copies(docs: DataFrame, cuts: DataFrame, seed: str) -> DataFrame:
    """``docs`` as ``d`` with ``size`` and ``copies``: how often the mix takes each document."""
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("source").alias("_source"), size(F.col("text")).alias("_size"), seeded(seed).alias("_draw"))
    sent = small(cuts, cuts.count(), BROADCAST_CUTS).select(F.col("source").alias("s"), F.col("size").alias("z"), "rounds", "cut")
    taken = F.coalesce(F.col("rounds") + (F.col("_draw") <= F.col("cut")).cast("long"), F.lit(0))
    return sized.join(sent, F.col("_source").eqNullSafe(F.col("s")) & (F.col("_size") == F.col("z")), "left").select("d", F.col("_size").alias("size"), taken.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns."""
    _, cuts = plan(docs, seed)
    return copies(docs, cuts, seed).where("copies > 0").select("d", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("d.*")


def report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    goal, cuts = plan(docs, seed)
    rows = copies(docs.select("doc_id", "source", "text"), cuts, seed).select("d.doc_id", "d.source", "size", "copies")
    known = goal.withColumnRenamed("source", "s")
    return rows.join(known, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )
