import brute
import pytest

from gradewright.llm import sharding
from pyspark.sql import functions as F
from llm_fixtures import awkward, clashing, frame, prose  # noqa: F401


def test_digest(frame, awkward):
    rows = awkward + [(1000 + i, f"t{i}") for i in range(2000)]
    got = sharding.digest(frame(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, t)
    for r in got:
        assert r.size == 8 + len((texts[r.doc_id] or "").encode()) and r.text_crc32 == brute.crc(texts[r.doc_id]) and r.law == "key"
        assert r.grown_shard in (r.shard, 24)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 40
    moved = sum(r.grown_shard == 24 for r in got)
    assert len(rows) / 25 * 0.6 < moved < len(rows) / 25 * 1.5
    again = sharding.digest(frame(list(reversed(rows))).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_a_weight_moves_rows_only_through_its_own_subtree(spark):
    ids = spark.range(5000).select(F.col("id").alias("k"))
    base = sharding.tree(24)
    heavy = list(base.children)
    rack = heavy[1].children[0]
    shards = (sharding.Node(rack.children[0].name, own_weight=3.0, shard=rack.children[0].shard), *rack.children[1:])
    heavy[1] = sharding.Node(heavy[1].name, (sharding.Node(rack.name, shards), *heavy[1].children[1:]))
    pairs = ids.select(sharding.draw(F.col("k"), base).alias("a"), sharding.draw(F.col("k"), sharding.Node("root", tuple(heavy))).alias("b"))
    moved = [(r.a, r.b) for r in pairs.where("a <> b").collect()]
    region = lambda s: s // 8
    assert moved and all(region(b) == 1 for _, b in moved)
    assert not any(region(a) == 1 and a // 4 != b // 4 and b // 4 != 2 for a, b in moved)  # inside the region only into the heavier rack
    share = pairs.where("b = 8").count() / 5000
    assert share == pytest.approx(3 / 26, rel=0.2)


@pytest.mark.parametrize("shards", [1, 2, 8, 22, 24, 25, 26, 31, 40])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    """From so many shards to the next, and what was foretold is what comes. (Between 23 and 24 the tree is built.)"""
    ids = sharding.assign(spark.range(400).select(F.col("id").alias("k")), "k", shards)
    now = ids.withColumnsRenamed({"shard": "was", "grown_shard": "foretold"})
    got = sharding.assign(now, "k", shards + 1).collect()
    assert all(r.shard == r.foretold and r.shard in (r.was, shards) for r in got)
    assert {r.was for r in got} <= set(range(shards))


@pytest.mark.parametrize("shards", range(1, 41))
def test_trees_grow_by_one_region(shards):
    """The tree of one more shard is the grown tree, for every number of shards but the one before the tree is built."""
    if shards != sharding.BUILT - 1:
        assert sharding.tree(shards + 1) == sharding.grow(sharding.tree(shards))


def test_columns_stay(frame, clashing, awkward):
    df = clashing(frame(awkward))
    out = sharding.shard_documents(df)
    assert set(out.columns) == set(df.columns) | {"grown_shard"} and out.count() == len(awkward)
    odd = frame(awkward).withColumns({c: F.lit(c) for c in ("_bucket", "_row", "_shift", "row")})
    assert {(r["_bucket"], r["_row"], r["_shift"], r["row"]) for r in sharding.shard_documents(odd).collect()} == {("_bucket", "_row", "_shift", "row")}
    assert sharding.digest(frame([])).count() == 0 and sharding.shard_documents(frame([])).count() == 0
