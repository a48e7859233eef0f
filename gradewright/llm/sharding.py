"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child draws ``-ln(u) / weight`` from a hash of the key and the child's name; the lowest draw
takes the row. A child's share follows its weight, and a changed weight moves rows only into or out of that
child. The first ``BUILT`` shards are built together, rack by rack; every later one joins as a region of its own, so that rows move
into it and nowhere else, however often the tree grows. (Fewer than ``BUILT`` shards are regions of their own; rows move when these are built together.)

Defined results: a null key counts as the word null; a null text has size 8 and the checksum of no bytes; equal keys
share a shard; rows alike in all order columns share their slots in either order. Weights are positive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.common import uniform

BUCKETS = 2048  # of the rows of a shard; a window holds one bucket
BUILT = 24


@dataclass(frozen=True)
class Node:
    """A branch, or a shard if it has no children. A branch weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float = 1.0
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, racks: int = 2, per_rack: int = 4, built: int = BUILT) -> Node:
    """``shards`` equal shards: the first ``built`` of them filled rack by rack and region by region, the others each a region."""
    per_region = racks * per_rack
    together = built if shards >= built else 0

    def rack(first: int, last: int) -> Node:
        return Node(f"rack{first}", tuple(Node(f"shard{s}", shard=s) for s in range(first, last)))

    def region(first: int, last: int) -> Node:
        return Node(f"region{first}", tuple(rack(r, min(r + per_rack, last)) for r in range(first, last, per_rack)))

    regions = [region(f, min(f + per_region, together)) for f in range(0, together, per_region)]
    return Node("root", (*regions, *(alone(s) for s in range(together, shards))))


def alone(shard: int, weight: float = 1.0) -> Node:
    """A region of one shard."""
    return Node(f"region{shard}", (Node(f"rack{shard}", (Node(f"shard{shard}", own_weight=weight, shard=shard),)),))


def grow(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own: no other branch changes its weight."""
    return Node("root", (*root.children, alone(1 + max(_shards(root)), weight)))


def _shards(node: Node) -> list[int]:
    return [s for c in node.children for s in _shards(c)] if node.children else [node.shard]


def draw(key: Column, node: Node, seed: str = "s0") -> Column:
    """The shard that a key reaches from a node."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return draw(key, node.children[0], seed)
    scored = [
        F.struct((-F.log(uniform(F.lit(seed), F.lit(c.name), key)) / F.lit(c.weight)).alias("score"), F.lit(i).alias("child"))
        for i, c in enumerate(node.children)
    ]
    won = F.least(*scored)["child"]
    if not any(c.children for c in node.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in node.children]), won + 1)
    out = F.when(won == 0, draw(key, node.children[0], seed))
    for i, c in enumerate(node.children[1:], 1):
        out = out.when(won == i, draw(key, c, seed))
    return out


def assign(df: DataFrame, key: str, shards: int = 24, seed: str = "s0") -> DataFrame:
    """Adds ``shard`` and ``grown_shard``, the shard with one more. Columns of these names are replaced."""
    root = tree(shards)
    grown = grow(root)
    new, seeded = grown.children[-1], seed
    best = F.array_min(F.array(*[-F.log(uniform(F.lit(seeded), F.lit(c.name), F.col(key))) / F.lit(c.weight) for c in root.children]))
    mine = -F.log(uniform(F.lit(seeded), F.lit(new.name), F.col(key))) / F.lit(new.weight)
    # the other branches keep their draws, so the grown tree is the old one with one more draw at the top
    return df.withColumn("shard", draw(F.col(key), root, seed)).withColumn(
        "grown_shard", F.when(mine < best, F.lit(new.children[0].children[0].shard)).otherwise(F.col("shard"))
    )


def with_slots(df: DataFrame, key: str, order: list[str], seed: str = "s0") -> DataFrame:
    """Adds ``slot``: rows of a shard numbered from 0 without gaps. Rows are numbered inside hashed buckets and
    shifted by the sizes of the buckets before; only the sizes, ``BUCKETS`` per shard at most, meet."""
    columns = df.columns
    df = df.select(F.struct("*").alias("row"), "shard")
    key, order = f"row.{key}", [f"row.{c}" for c in order]
    bucketed = df.withColumn("_bucket", F.floor(uniform(F.lit(seed), F.lit("slot"), F.col(key)) * BUCKETS).cast("int"))
    sizes = bucketed.groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(*order)
    return (
        bucketed.withColumn("_row", F.row_number().over(inside))
        .join(shifts, ["shard", "_bucket"])
        .withColumn("slot", (F.col("_shift") + F.col("_row") - 1).cast("long"))
        .select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: str = "s0") -> DataFrame:
    """The documents with ``shard``, ``grown_shard`` and ``slot``."""
    return with_slots(assign(docs.drop("slot"), "doc_id", shards, seed), "doc_id", ["doc_id", "text"], seed)


def digest(docs: DataFrame, shards: int = 24, seed: str = "s0") -> DataFrame:
    """Size and checksum instead of the text, so that only these travel."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
    )
    return with_slots(assign(rows, "doc_id", shards, seed), "doc_id", ["doc_id", "size", "text_crc32"], seed).withColumn("law", F.lit("key"))
