"""Benchmark decontamination: a broadcast hash set of test n-grams against training token windows.

Words are runs of letters, digits and non-ASCII characters after A-Z is lowered. An item gives every window
of ``n`` consecutive words; an item of fewer words is one window. Each window is filed under its longest
word, its anchor. The corpus is scanned once: a word that is an anchor is looked up in the hash set, and the
window around it is compared word by word. A word inside any window found is hit.

Defined results: a null or wordless text has no words and no hits; an item without words has no window; items
with one item_id count once, a null item_id reads as the empty string; rows that repeat a doc_id and text get the
same result each; extra columns pass through. Columns of ``docs`` named as result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewright.llm.common import keep, lower_ascii, pieces, small

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between lowered words
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before A-Z is lowered
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 4_000_000  # a window is about 100 bytes; more windows are joined by a shuffle


def text_words(text) -> F.Column:
    return pieces(lower_ascii(text), BREAKS)


def windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct windows: ``gram`` (the words), ``size``, ``anchor``, its ``offset``, and the ``items`` it is from."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_words(F.col("text")).alias("w")
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    grams = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram"))
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.length(w).alias("chars"), w.alias("word"), i.alias("at"))))
    return (
        grams.groupBy("gram")
        .agg(F.collect_set("item").alias("items"))
        .select("gram", "items", F.size("gram").alias("size"), longest.alias("a"))
        .select("gram", "items", "size", F.col("a.word").alias("anchor"), F.col("a.at").alias("offset"))
    )


def _identity():
    """A row by its doc_id and whole text; rows alike in both have the same hits."""
    return [F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.length("text").alias("_chars")]


IDENTITY = ["_id", "_hash", "_chars"]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document with a hit: the distinct ``spans`` (first word, words) and ``items``."""
    grams = keep(windows(benchmark, n), "windows")
    found = (
        docs.select(*_identity(), text_words(F.col("text")).alias("w"))
        .select("*", F.posexplode_outer("w").alias("at", "word"))
        .join(
            small(grams, grams.count(), BROADCAST_WINDOWS),
            (F.col("word") == F.col("anchor"))
            & (F.col("at") >= F.col("offset"))
            & (F.slice("w", F.greatest(F.col("at") - F.col("offset"), F.lit(0)) + 1, F.col("size")) == F.col("gram")),
        )
        .select(*IDENTITY, F.struct((F.col("at") - F.col("offset")).alias("first"), F.col("size").alias("words")).alias("span"), "items")
    )
    return found.groupBy(*IDENTITY).agg(
        F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def hit_words(spans: str) -> F.Column:
    """The distinct positions that spans cover."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["first"], s["first"] + s["words"] - 1))))


def _with_hits(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in IDENTITY]
    return docs.select("*", *_identity()).alias("d").join(found.alias("f"), same, how)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per document: words, hit words, items with an occurring window (sorted as strings), and the verdict."""
    found = hits(docs, benchmark, n).select(*IDENTITY, F.size(hit_words("spans")).alias("hit"), "items")
    narrow = docs.select("doc_id", F.size(text_words(F.col("text"))).cast("long").alias("n_words"), *_identity())
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"f.{k}")) for k in IDENTITY]
    return (
        narrow.alias("d")
        .join(found.alias("f"), same, "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce(F.col("hit"), F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents without a hit, with their own columns."""
    return _with_hits(docs, hits(docs, benchmark, n), "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All documents; hit words are cut out of the text, what stands between words stays. ``n_chars``, if there
    is one, follows the text."""
    found = hits(docs, benchmark, n).select(*IDENTITY, hit_words("spans").alias("hit"))
    raw, between = pieces(F.col("d.text"), RAW_BREAKS), F.split("d.text", RAW_WORDS)
    left = F.transform(
        raw, lambda w, i: F.concat(F.when(F.array_contains("hit", i), "").otherwise(w), F.element_at(between, i + 2))
    )
    cut = F.when(F.col("hit").isNull(), F.col("d.text")).otherwise(F.concat(F.element_at(between, 1), F.array_join(left, "")))
    out = [cut.alias(c) if c == "text" else F.length(cut).cast("long").alias(c) if c == "n_chars" else F.col(f"d.`{c}`") for c in docs.columns]
    return _with_hits(docs, found, "left").select(*out)
