"""MinHash near-duplicate detection with sequential Bayesian verification.

Words are lowered (A-Z) runs without ASCII white space. A document's set holds its distinct shingles of five words; a
document of fewer words has its whole sequence as the only shingle; one without words has none and is linked with nothing.
Two documents are linked if their sets' Jaccard similarity is ``SIMILARITY`` or more. Every linked group keeps the
document with the smallest id.

1. Documents with the same word sequence are one node, found by a pre-aggregated minimum; copies go no further.
2. A node's signature has ``HASHES`` minima of 16 bits. The first ``BANDS * ROWS`` make the buckets of candidates; a pair
   at the similarity shares no bucket with a probability of 5 in a million.
3. First every node is compared with the first node of each of its buckets, which joins most of a group without its pairs.
   Then, only in buckets that still hold more than one component, nodes of different components are compared in blocks,
   nearest pairs first, and a pair that such a task has already joined is passed over.
4. A comparison reads the signatures batch by batch and stops as soon as the posterior probability that the
   similarity reaches the bound (uniform prior) falls below ``MISS``. Survivors are confirmed on the full sets.

Defined results: rows with one doc_id are one document; a row without doc_id is counted, linked with nothing and kept; an
empty table gives an empty result; extra columns pass through. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from gradewright.llm.common import keep, small

SHINGLE = 5
SIMILARITY = (75, 100)
BANDS, ROWS, HASHES, BATCH = 32, 4, 256, 32
MISS = 1e-5
BLOCK = 512  # nodes of a bucket that one task compares with as many others
BROADCAST_NODES = 1_000_000  # node ids (8 bytes each) that are sent to every task to choose the texts of candidates
_rng = np.random.default_rng(20_011)
_SHINGLE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only


def shingle_set(parts: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    ids = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    if not len(ids):
        return ids
    if len(ids) < SHINGLE:
        return np.array([xxh3_64_intdigest(b" ".join(parts), seed=1)], np.uint64)
    mixed = np.zeros(len(ids) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        mixed += ids[k : k + len(mixed)] * _SHINGLE[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minimum under each hash."""
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 256):
        np.minimum(least, (low[i : i + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def needed(similarity: float = SIMILARITY[0] / SIMILARITY[1], miss: float = MISS) -> list[int]:
    """After 1, 2, .. batches, the least agreements whose posterior still allows the similarity: with a uniform
    prior, P(J >= t | m of n) is the probability of m or fewer successes in n + 1 draws of t."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of signature rows, the indices that no batch rules out."""
    left, agree = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(needed()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (a[left, part] == b[left, part]).sum(axis=1, dtype=np.int32)
        stay = agree >= least
        left, agree = left[stay], agree[stay]
        if not len(left):
            break
    return left


def similar_sizes(m, n):
    """Whether sets of these sizes can reach the similarity."""
    least, most = np.minimum(m, n), np.maximum(m, n)
    return SIMILARITY[1] * least >= SIMILARITY[0] * most


def similar(a: bytes, b: bytes) -> bool:
    """The exact test on full sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILARITY[1] * shared >= SIMILARITY[0] * (len(x) + len(y) - shared)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``key`` of the word sequence (null without words), ``sig``."""
    kind = StructType([StructField("n_shingles", LongType()), StructField("key", BinaryType()), StructField("sig", BinaryType())])

    @F.pandas_udf(kind)
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                parts = words(text)
                shingles = shingle_set(parts)
                some = len(shingles) > 0
                rows.append((len(shingles), xxh3_128_digest(b" ".join(parts)) if some else None, signature(shingles).tobytes() if some else None))
            yield pd.DataFrame(rows, columns=["n_shingles", "key", "sig"])

    return docs.select("doc_id", signed("text").alias("s")).select("doc_id", "s.*")


@F.pandas_udf(StructType([StructField("key", BinaryType()), StructField("set", BinaryType())]))
def _sets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:  # one text's words at a time
            parts = words(text)
            rows.append((xxh3_128_digest(b" ".join(parts)), shingle_set(parts).tobytes()))
        yield pd.DataFrame(rows, columns=["key", "set"])


def _rows(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), HASHES)


def _prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        rows = rows[similar_sizes(rows["n_a"], rows["n_b"])]
        if len(rows):
            yield rows.iloc[survivors(_rows(rows["sig_a"]), _rows(rows["sig_b"]))][["a", "b"]]


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        good = [similar(x, y) for x, y in zip(rows["set_a"], rows["set_b"], strict=True)]
        yield rows.loc[good, ["a", "b"]]


def _with(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """A node table's columns for both sides of pairs."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


class Merged:
    """Components joined inside one task, so that a pair already joined is not confirmed again."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, c: int) -> int:
        while (u := self.up.get(c, c)) != c:
            c = u
        return c

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


COMPARED = ("bucket", "i", "j", "band", "node", "comp", "part", "n", "sig", "set")


def _compare(rows: dict[str, np.ndarray], sig: np.ndarray, merged: Merged) -> list[tuple[int, int]]:
    """The confirmed links of one block pair of a bucket between different components, nearest pairs first. A pair that
    shares an earlier band is left to that band's bucket."""
    n, comp, first, band = rows["n"], rows["comp"], rows["part"] == rows["i"], int(rows["band"][0])
    one_block, pairs = rows["i"][0] == rows["j"][0], []
    for x in np.flatnonzero(first):
        others = np.arange(x + 1, len(n)) if one_block else np.flatnonzero(~first)
        others = others[(comp[others] != comp[x]) & similar_sizes(n[others], n[x])]
        if len(others) and len(good := others[survivors(np.broadcast_to(sig[x], (len(others), HASHES)), sig[others])]):
            same = sig[good] == sig[x]
            seen = same[:, : band * ROWS].reshape(len(good), band, ROWS).all(axis=2).any(axis=1)
            pairs += [(-int(m), int(x), int(y)) for m, y in zip(same[~seen].sum(axis=1), good[~seen], strict=True)]
    out = []
    for _, x, y in sorted(pairs):
        if merged.top(int(comp[x])) != merged.top(int(comp[y])) and similar(rows["set"][x], rows["set"][y]):
            merged.join(int(comp[x]), int(comp[y]))
            out.append((int(rows["node"][x]), int(rows["node"][y])))
    return out


def _compare_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Block pairs arrive one after another; a batch may end inside one."""
    merged, rest = Merged(), None
    for batch in chain(batches, [None]):
        rows = [x for x in (rest, batch) if x is not None]
        if not rows:
            return
        rows = pd.concat(rows, ignore_index=True)
        keys = rows[["bucket", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        whole = len(cuts) - 1 if batch is None else len(cuts) - 2  # the last one may go on
        columns, links = {c: rows[c].to_numpy() for c in COMPARED}, []
        sig = _rows(rows["sig"])
        for start, end in zip(cuts[:whole], cuts[1:], strict=False):
            if end - start > 1:
                links += _compare({c: v[start:end] for c, v in columns.items()}, sig[start:end], merged)
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])
        rest = rows.iloc[cuts[whole] :] if batch is not None else None


def across(members: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed links between nodes that share a bucket and lie in different components. A large bucket is cut into
    parts; each pair of parts is a task's work, and parts of one component alone are no work."""
    comp = F.coalesce("root", "node").alias("comp")
    placed = keep(members.join(labels, "node", "left").select("bucket", "band", "node", comp), "near-members")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = (
        placed.join(mixed.select("bucket", parts.alias("parts")), "bucket")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("bucket", "band", "node", "comp", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
        .join(nodes.select("node", F.col("n_shingles").alias("n"), "sig", "set"), "node")
        .select(*COMPARED)
    )
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return dealt.mapInPandas(_compare_sorted, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every linked node: large stars and small stars in
    turn until nothing changes. Each round is written, so a lost executor repeats one round."""

    def star(edges: DataFrame) -> DataFrame:
        """Each node's neighbours are tied to the smallest of them."""
        low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return edges.join(low, "u")

    def both(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("u").alias("u"), F.col("v").alias("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "near-links")
    before = None
    while True:
        large = star(both(edges)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        tied = star(large)
        edges = keep(tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).where("u > v").distinct(), "near-stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The signature table, and for each word sequence (``key``) its ``component``."""
    signed = keep(signatures(docs), "near-signatures")
    reps = keep(signed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node")), "near-copies")
    nodes = signed.join(reps, (signed["key"] == reps["key"]) & (signed["doc_id"] == reps["node"])).select("node", reps["key"], "n_shingles", "sig")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring("sig", k * 2 * ROWS + 1, F.lit(2 * ROWS)), k))
    buckets = nodes.select("node", F.posexplode(bands).alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    members = keep(buckets.join(shared, "bucket").select("bucket", "band", "node", "first"), "near-buckets")
    chosen = keep(members.select("node").distinct(), "near-candidates")
    few = small(chosen, chosen.count(), BROADCAST_NODES)
    texts = docs.join(few, F.col("doc_id") == F.col("node"), "left_semi")
    sets = texts.select(F.col("doc_id").alias("node"), _sets("text").alias("s")).select("node", "s.*")
    one = ["node", "key"]  # repeated rows are one node
    nodes = keep(nodes.join(few, "node", "left_semi").dropDuplicates(one).join(sets.dropDuplicates(one), one), "near-nodes")

    firsts = members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    near = keep(_with(firsts, nodes.select("node", F.col("n_shingles").alias("n"), "sig"), ["n", "sig"]).mapInPandas(_prune, "a long, b long"), "near-pairs")
    links = _with(near, nodes.select("node", "set"), ["set"]).mapInPandas(_confirm, "a long, b long")
    labels = components(links)
    more = across(members.select("bucket", "band", "node"), labels, nodes)
    labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return signed, reps.join(labels, "node", "left").select("key", F.coalesce("root", "node").alias("component"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: the size of its set, its component, and whether it is the one that stays."""
    signed, found = classes(docs)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", F.col("key").alias("k")).join(found, F.col("k") == F.col("key"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    gone = report(docs).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
