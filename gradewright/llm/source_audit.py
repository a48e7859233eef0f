"""Source divergence audit by in-mapper stripes.

A task folds whole documents into stripes: for each language and term, the number of documents with the term and its
occurrences by source. When a task's stripes hold ``CELLS`` cells they are spilled as rows and it starts anew. Spilled stripes are dealt out by
language and term, sorted, and merged in one pass that holds ``ROWS`` of them; those of ``LEAST`` documents or more are kept. A merged
stripe, with the sums of its language beside it, gives its part of every pair's divergence and its own divergence from the language:
pairs are summed inside a task before they are shuffled, and of the terms a task keeps the ``TOP`` of each group.

With counts c of N occurrences of V terms, a term's share in a group is ``p = 1 + floor(1e9 * (c + 2) / (N + 2 V))``, and the divergence of two shares
``floor((p - q)^2 / (p + q))``. All numbers are whole. Groups are (lang, source); the sources of one language are compared in pairs, as the result lists all
of them; a task's sums of pairs are spilled when there are ``CELLS`` of them.

Defined results: null text, lang and source are ''; a group without kept terms has count 0 for every term; a language without kept terms has
divergences of 0 and no terms; repeated rows are documents of their own; ids do not matter; extra columns are ignored; ties go by
name, by bytes; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.common import keep, small

LEAST, TOP = 10, 10
SCALE, EXTRA = 1_000_000_000, 2
CELLS = 600_000  # of a task's stripes or pair sums
ROWS = 100_000  # stripes that a task merges at a time
GROUPS = 100_000  # of all languages, that are sent to every task
BLOCK = 1 << 20  # shares that a task has at a time
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GROUP = ""  # stands for a term where a stripe only says that its groups exist
STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
PART = "lang string, source string, part string, item string, value long"


def terms(text: str) -> list[str]:
    """The terms of a text in order; only A-Z are lower-cased."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


NAMES = ["lang", "term", "df", "sources", "counts"]


class Stripes:
    """A task's stripes: for each language the documents of every term, and for each of its sources the occurrences."""

    def __init__(self) -> None:
        self.df: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}

    def add(self, lang: str, source: str, text: str) -> None:
        words = terms(text)
        self.df.setdefault(lang, Counter()).update(set(words))
        self.counts.setdefault(lang, {}).setdefault(source, Counter()).update(words)

    def cells(self) -> int:
        return sum(len(c) for by in self.counts.values() for c in by.values())

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, by in self.counts.items():
            source, term, n = [pa.array([s for s in by])], [pa.array([GROUP] * len(by))], [pa.array([0] * len(by), pa.int64())]
            for s, c in by.items():
                source.append(pa.repeat(pa.scalar(s), len(c)))
                term.append(pa.array(list(c), pa.string()))
                n.append(pa.array(list(c.values()), pa.int64()))
            flat = pa.table({"term": pa.chunked_array(term), "sources": pa.chunked_array(source), "counts": pa.chunked_array(n)})
            rows = flat.group_by("term", use_threads=False).aggregate([("sources", "list"), ("counts", "list")])
            df = self.df[lang]
            found = [df[t] for t in rows["term"].to_pylist()]
            out = pa.table([pa.repeat(pa.scalar(lang), len(rows)), rows["term"], pa.array(found, pa.int64()), rows["sources_list"], rows["counts_list"]], NAMES)
            yield from out.combine_chunks().to_batches(max_chunksize=20_000)
        self.__init__()


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) to stripes."""
    held, since = Stripes(), 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.add(lang, source, text)
            since += len(text)
            if since > CELLS:  # a cell takes a character at least
                if held.cells() >= CELLS:
                    yield from held.spill()
                since = 0
    yield from held.spill()


def combined(rows: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
    """Sorted stripes with those of one key added up: the ones to keep, and the last key's, which may go on unless this is the ``last`` part."""
    lang, term, many = rows["lang"], rows["term"], len(rows)
    new = np.ones(many, bool)
    if many > 1:
        differs = [pc.not_equal(c.slice(1), c.slice(0, many - 1)).to_numpy() for c in (lang, term)]
        new[1:] = differs[0] | differs[1]
    starts, key = np.flatnonzero(new), np.cumsum(new) - 1
    df = np.add.reduceat(rows["df"].to_numpy(), starts)
    kept = (df >= LEAST) | pc.equal(term.take(pa.array(starts)), GROUP).to_numpy()
    kept[-1] = kept[-1] or not last
    rows, key = rows.filter(pa.array(kept[key])).combine_chunks(), key[kept[key]]
    if not len(rows):
        return rows, rows
    sources, counts = (rows[c].chunk(0) for c in ("sources", "counts"))
    cells = pa.table({"key": key[pc.list_parent_indices(sources).to_numpy()], "source": sources.flatten(), "n": counts.flatten()})
    cells = cells.group_by(["key", "source"], use_threads=False).aggregate([("n", "sum")])
    out = cells.group_by("key", use_threads=False).aggregate([("source", "list"), ("n_sum", "list")]).sort_by("key")
    at = out["key"].to_numpy()
    firsts = pa.array(np.searchsorted(key, at))
    table = pa.table([rows["lang"].take(firsts), rows["term"].take(firsts), pa.array(df[at]), out["source_list"], out["n_sum_list"]], NAMES)
    return (table, table.slice(0, 0)) if last else (table.slice(0, len(table) - 1), table.slice(len(table) - 1))


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stripes to one for each language and term; those of too few documents go. A task has ``ROWS`` stripes at a time and what the
    key of the last ones adds up to."""
    held, many = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]).rename_columns(NAMES))
        many += len(batch)
        if many >= ROWS:
            done, rest = combined(pa.concat_tables(held, promote_options="permissive"), last=False)
            yield from done.combine_chunks().to_batches()
            held, many = [rest], len(rest)
    if many:
        yield from combined(pa.concat_tables(held, promote_options="permissive"), last=True)[0].combine_chunks().to_batches()


def merged(docs: DataFrame) -> DataFrame:
    """The kept stripes of all documents, and one of the empty term that names each language's groups."""
    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    spilled = read.mapInArrow(fold, STRIPE)
    dealt = spilled.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return keep(dealt.mapInArrow(merge, STRIPE), "audit-stripes")


def languages(kept: DataFrame) -> DataFrame:
    """``lang``, ``v`` (kept terms), ``groups``: its sources in order, each with the occurrences ``n`` of kept terms."""
    cells = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("n"))
    groups = cells.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups"))  # all sources are in the result's rows of pairs, too
    return kept.groupBy("lang").agg(F.count_if(F.col("term") != GROUP).alias("v")).join(groups, "lang")


def shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    if n.max(initial=0) >= 2**63 // SCALE - EXTRA:  # beyond 64 bits
        return 1 + ((counts.astype(object) + EXTRA) * SCALE // (n.astype(object) + 2 * v)).astype(np.int64)
    return 1 + (counts + EXTRA) * SCALE // (n + 2 * v)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def parts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["lang", "source", "part", "item", "value"])


class Language:
    """A language's sums, and what a task has gathered for it."""

    def __init__(self, name: str, v: int, groups: list[dict]) -> None:
        self.name, self.v = name, v
        self.sources = [g["source"] for g in groups]
        self.at = {s: i for i, s in enumerate(self.sources)}
        self.n = np.array([g["n"] for g in groups], np.int64)
        self.pairs: dict[int, np.ndarray] = {}  # source -> sums with the sources after it
        self.best: dict[int, list[tuple[int, str]]] = {}

    def add(self, stripes: list[tuple[str, list[str], list[int]]]) -> None:
        """Stripes that the memory of a task holds as shares."""
        counts = np.zeros((len(stripes), len(self.sources)), np.int64)
        for row, (_, sources, values) in enumerate(stripes):
            counts[row, [self.at[s] for s in sources]] = values
        p = shares(counts, self.n[None, :], self.v)
        for i in range(len(self.sources) - 1):
            sums = divergence(p[:, i + 1 :], p[:, i : i + 1]).sum(axis=0)
            self.pairs[i] = self.pairs[i] + sums if i in self.pairs else sums
        q = shares(counts.sum(axis=1), self.n.sum(keepdims=True), self.v)[:, None]
        value = divergence(p, q)
        for i in range(len(self.sources)):
            rows = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q[:, 0]))
            found = self.best.get(i, []) + [(-int(value[r, i]), stripes[r][0]) for r in rows]
            self.best[i] = sorted(found, key=lambda f: (f[0], f[1].encode("utf-8", "surrogatepass")))[:TOP]

    def cells(self) -> int:
        return sum(map(len, self.pairs.values()))

    def emit(self) -> Iterator[pa.RecordBatch]:
        for i, sums in self.pairs.items():
            ahead = [(self.name, self.sources[i], "pair", self.sources[i + 1 + j], int(x)) for j, x in enumerate(sums)]
            yield parts(ahead + [(lang, item, part, source, x) for lang, source, part, item, x in ahead])
        yield parts([(self.name, self.sources[i], "term", term, -x) for i, best in self.best.items() for x, term in best])
        self.pairs, self.best = {}, {}


def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged stripes (lang, term, sources, counts, v, groups) to their parts of the divergences."""
    of: dict[str, Language] = {}
    for batch in batches:
        lang, start = batch.column(0).to_pylist(), 0
        term, sources, counts = (batch.column(i).to_pylist() for i in (1, 2, 3))
        while start < len(lang):
            name = lang[start]
            if name not in of:
                if sum(len(x.sources) for x in of.values()) >= CELLS:
                    for x in of.values():
                        yield from x.emit()
                    of = {}
                of[name] = Language(name, batch.column(4)[start].as_py(), batch.column(5)[start].as_py())
            now, end = of[name], start
            most = start + max(1, BLOCK // max(1, len(now.sources)))
            while end < min(len(lang), most) and lang[end] == name:
                end += 1
            now.add(list(zip(term[start:end], sources[start:end], counts[start:end], strict=True)))
            start = end
            if sum(x.cells() for x in of.values()) >= CELLS:
                for x in of.values():
                    yield from x.emit()
    for x in of.values():
        yield from x.emit()


def report(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``."""
    kept = merged(docs)
    of = keep(languages(kept), "audit-languages")
    groups = of.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0))).first()[0]  # one row
    beside = kept.where(F.col("term") != GROUP).drop("df").join(small(of, groups, GROUPS), "lang").sortWithinPartitions("lang")
    found = keep(beside.select("lang", "term", "sources", "counts", "v", "groups").mapInArrow(emit, PART), "audit-parts")
    every = of.select("lang", F.explode("groups.source").alias("source"), F.col("groups.source").alias("items")).select(
        "lang", "source", F.lit("pair").alias("part"), F.explode("items").alias("item"), F.lit(0).cast("long").alias("value")
    )
    pairs = every.where("item <> source").unionByName(found.where("part = 'pair'")).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(found.where("part = 'term'")).withColumn("rank", place).where(f"part = 'pair' OR rank <= {TOP}")
