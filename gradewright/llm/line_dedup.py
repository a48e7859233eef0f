"""Line dedup by an exact set-similarity join.

Lines are the parts of a text between line feeds; a line's tokens are its distinct words (runs without ASCII white space).
Lines of equal token sets are one class, whose place is its first line by doc_id and number. Two classes are linked
if their sets' Jaccard similarity is ``SIMILARITY`` or more, and a line stays if it is the first of its class and no linked class
has an earlier line.

1. Tokens are counted over the whole corpus in ``BUCKETS`` hash buckets. A token's code has its bucket's count, in third
   octaves, in the upper bits and its hash below, so codes in ascending order are tokens from rare to frequent.
2. A linked pair shares one of the first ``n - ceil(t n) + 1`` codes of either set: only this prefix is indexed, by class.
3. A pair is a candidate if it meets at a code, its sizes can reach the similarity, its places in the two orders
   leave enough tokens for the overlap it needs, and so do the parities of 64 token buckets, 128 for larger sets (a pair's
   sets differ in one token at least for every parity that differs).
4. Candidates are confirmed on the words themselves, in cells of candidates that met at one code: a line is sent once to each of its cells.
5. Links in large groups of near copies are counted without meeting pair by pair. A group's centre is the words that most of its sets
   have. Two sets differ in no more words than both do from the centre, which decides nearly all links by one sum for each distance;
   the rest meet at words that both have, or lack, unlike the centre, whose number is exact. These pairs are left out of step 3.

All links are found and counted, in a group of near copies all its pairs.

Only DataFrame functions run. Defined results: a null text has no lines; lines without a word are kept, have no class and no
links; rows without doc_id come first; repeated rows share their places and are judged alike; extra columns pass through in ``clean``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.common import keep_alone, setting, small

SIMILARITY = (3, 4)
BUCKETS = 1 << 21
BLOCK = 1 << 12  # buckets whose ranks are gathered in one row
RANK_BITS = 7
WIDE = 48  # sets of so many tokens have parities by 128 buckets; by 64, those of any two large sets differ too little
SHORT = 32  # low bits that codes leave out in the index
NEAR_LEAST = 16  # classes that share a pair of neighbouring codes from which they are a group
NEAR_CODES = 64  # codes of a prefix whose pairs are looked at
BROADCAST_CENTRES = 100_000  # centres (some hundred bytes each) that are sent to every task
BROADCAST_LINES = 1_000_000  # candidate lines (100 to 200 bytes each) that are sent to every task to choose their words
CELL_PAIRS = 20_000  # candidates that are confirmed together


def spaced(blanks: str) -> Column:
    """The text with these blanks as spaces."""
    text = F.col("text")
    for blank in blanks:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``line``; only lines with a word, their blanks as spaces."""
    rows = docs.select("doc_id", F.posexplode(F.split(spaced("\t\v\f\r"), "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def pieces(line: Column) -> Column:
    """The words of a line, and empty texts between neighbouring blanks. One plain character splits without an expression."""
    return F.split(line, " ")


def tokens(line: Column) -> Column:
    return F.array_remove(F.array_distinct(pieces(line)), "")


def rarity(docs: DataFrame) -> DataFrame:
    """One row: an array with the logarithmic count of every bucket, of all tokens of all documents."""
    words = docs.select(F.explode(pieces(spaced("\t\v\f\r\n"))).alias("t")).where("t != ''")
    counted = words.groupBy(F.xxhash64("t").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).count()
    ranked = F.least(F.floor(F.log2(F.col("count")) * 3), F.lit(2**RANK_BITS - 1)).cast("tinyint")
    every = docs.sparkSession.range(BUCKETS).join(counted, F.col("id") == F.col("b"), "left")
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda p: p["v"])
    blocks = every.groupBy(F.floor(F.col("id") / BLOCK).alias("block")).agg(in_order(F.col("id"), F.coalesce(ranked, F.lit(0).cast("tinyint"))).alias("ranks"))
    return blocks.agg(F.flatten(in_order(F.col("block"), F.col("ranks"))).alias("ranks"))


def codes(line: Column, ranks: Column) -> Column:
    """The sorted codes of a line's distinct words."""
    hashed = F.array_remove(F.array_distinct(F.transform(pieces(line), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))
    rank = lambda h: F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long")
    return F.sort_array(F.transform(hashed, lambda h: F.shiftleft(rank(h), 63 - RANK_BITS).bitwiseOR(h.bitwiseAND(F.lit(2 ** (63 - RANK_BITS) - 1)))))


def parities(codes: Column, odd: bool = False) -> Column:
    """64 bits: whether the number of codes with this remainder is odd; with ``odd``, of the codes whose quotient is odd."""
    counts = (lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(1).cast("long"))) if odd else (lambda c: F.lit(1).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", counts(c), c.bitwiseAND(63).cast("int"))))


def prefix(codes: Column) -> Column:
    """The upper bits of the first codes; codes that differ below meet without need and are told apart by their words."""
    s, t = SIMILARITY
    n = F.size(codes)
    return F.transform(F.slice(codes, F.lit(1), n - F.ceil(n * s / t).cast("int") + 1), lambda c: F.shiftright(c, SHORT).cast("int"))


FIRST = -(2**63)  # stands for a null doc_id, before all others


def doc_key() -> Column:
    return F.coalesce("doc_id", F.lit(FIRST).cast("long"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines with the key of their token set, and for each set its id, first place, size, parities and prefix."""
    ranks = keep_alone(rarity(docs), "line-rarity").scalar()  # one array of fixed size
    coded = lines(docs).withColumn("ranks", ranks).select("doc_id", "line_no", F.xxhash64("line").alias("says"), codes(F.col("line"), F.col("ranks")).alias("codes"))
    placed = keep_alone(
        coded.select(
            "doc_id", "line_no", "says", F.xxhash64("codes").alias("k1"), F.xxhash64("codes", F.lit(1)).alias("k2"), F.size("codes").alias("n"),
            parities(F.col("codes")).alias("bits"),
            F.when(F.size("codes") >= WIDE, parities(F.col("codes"), odd=True)).otherwise(F.lit(0).cast("long")).alias("odd_bits"), prefix(F.col("codes")).alias("prefix"),
        ),
        "line-sets",
    )
    place = F.min(F.struct(doc_key().alias("doc"), F.col("line_no").alias("line"), "says")).alias("place")
    sets = placed.groupBy("k1", "k2").agg(place, *[F.first(c).alias(c) for c in ("n", "bits", "odd_bits", "prefix")])
    sets = sets.select("k1", "k2", "place.*", "n", "bits", "odd_bits", "prefix", F.monotonically_increasing_id().alias("id"))
    return placed.select("doc_id", "line_no", "k1", "k2"), keep_alone(sets, "line-classes")


def groups(sets: DataFrame) -> DataFrame:
    """``id`` and ``near`` of the classes that have a pair of neighbouring codes in common with ``NEAR_LEAST`` classes or more: the pair
    that most classes have, or the one that most classes with this pair chose. It decides how pairs are counted, never whether."""
    often = math.floor(math.log2(NEAR_LEAST) * 3) << (63 - RANK_BITS - SHORT)  # rarer codes have too few lines
    pairs = F.arrays_zip(F.col("prefix").alias("a"), F.slice("prefix", 2, NEAR_CODES).alias("b"))
    key = F.shiftleft(F.col("p.a").cast("long"), 32).bitwiseOR(F.col("p.b").cast("long"))
    keyed = sets.select("id", F.explode(pairs).alias("p")).where((F.col("p.a") >= often) & F.col("p.b").isNotNull()).select("id", key.alias("key"))
    keyed = keyed.where(F.xxhash64("key").bitwiseAND(F.lit(1)) == 0)  # near copies share many pairs: half of them are enough to meet by
    shared = keep_alone(keyed.groupBy("key").count().where(F.col("count") >= NEAR_LEAST), "line-keys")
    mine = keyed.join(small(shared, shared.count(), BROADCAST_LINES), "key").groupBy("id")
    chosen = keep_alone(mine.agg(F.max(F.struct("count", "key"))["key"].alias("chosen"), F.collect_list("key").alias("keys")), "line-chosen-keys")
    votes = chosen.select(F.explode("keys").alias("key"), "chosen").groupBy("key", "chosen").count()
    won = votes.groupBy("key").agg(F.max(F.struct("count", "chosen"))["chosen"].alias("near"))
    return chosen.join(won, F.col("chosen") == F.col("key")).select("id", "near")


def said(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The lines at the places (``doc``, ``at``, ``says``) of chosen classes; a repeated row says its lines again."""
    rows = chosen.count()
    few = small(chosen, rows, BROADCAST_LINES)
    docs = docs.join(small(chosen.select(F.col("doc").alias("of")).distinct(), rows, BROADCAST_LINES), doc_key() == F.col("of"), "left_semi")
    here = (doc_key() == F.col("doc")) & (F.col("line_no") == F.col("at")) & (F.xxhash64("line") == F.col("says"))
    return lines(docs).join(few, here)


def around(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes of near copies, each with its group, the words in which it differs from the words that most of the group have,
    and its slack: how far it may still differ, times ``s + t``. Sets that differ much from their group are not in it."""
    s, t = SIMILARITY
    chosen = keep_alone(groups(sets).join(sets, "id").select("id", "near", "doc", F.col("line").alias("at"), "says"), "line-grouped")
    one = said(docs, chosen).groupBy("id").agg(*[F.first(c).alias(c) for c in ("near", "doc", "at", "says", "line")])
    members = keep_alone(one.select("id", "near", F.struct("doc", "at", "says", "id").alias("place"), tokens(F.col("line")).alias("words")), "line-members")
    sizes = members.groupBy("near").agg(F.count("*").alias("members"))
    words = members.select("near", F.explode("words").alias("w")).groupBy("near", "w").count().join(sizes, "near")
    centres = keep_alone(words.where("2 * count > members").groupBy("near").agg(F.collect_list("w").alias("centre")), "line-centres")
    met = members.join(small(centres, centres.count(), BROADCAST_CENTRES), "near")
    away = F.concat(F.array_except("words", "centre"), F.array_except("centre", "words"))
    far = met.select("id", "near", "place", F.size("words").alias("n"), away.alias("away")).withColumn("r", F.size("away").cast("long"))
    slack = (t - s) * F.col("n") - (s + t) * F.col("r")
    return keep_alone(far.where((s + t) * F.col("r") <= 2 * (t - s) * F.col("n")).select("id", "near", "place", "away", "r", slack.alias("slack")), "line-around")


def sure(members: DataFrame) -> DataFrame:
    """``id``, ``n_links``, ``later`` by the links in each group that slack alone decides: two sets differ in no more words than both do from
    the centre, so they are linked if their slacks sum to 0 or more. Slacks are counted, and summed from the largest down."""
    held = members.groupBy("near", "slack").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    asked = held.select("near", (-F.col("slack")).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(held.schema["first"].dataType).alias("first"), F.col("slack").alias("of"))
    steps = held.select("near", F.col("slack").alias("at"), "n", "first", F.lit(None).cast("long").alias("of")).unionByName(asked)
    above = Window.partitionBy("near").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = steps.select("near", "of", F.sum("n").over(above).alias("n"), F.min("first").over(above).alias("first")).where("of IS NOT NULL")
    told = told.select(F.col("near").alias("group"), "of", "n", "first")
    here = members.join(told, (F.col("near") == F.col("group")) & (F.col("slack") == F.col("of")))
    itself = F.when(F.col("slack") >= 0, 1).otherwise(0)
    return here.select("id", (F.col("n") - itself).alias("n_links"), F.coalesce(F.col("first") < F.col("place"), F.lit(False)).alias("later")).where("n_links > 0")


def unsure(members: DataFrame) -> DataFrame:
    """The links in each group that slack leaves open. The words that both sets have apart from the centre, or both lack, make them differ
    in fewer: only pairs with such words meet, their number decides, and a pair is taken at the first of them."""
    s, t = SIMILARITY
    apart = members.select("near", "id", "place", "r", "slack", "away", F.explode("away").alias("w"))
    a, b = apart.where("slack < 0").alias("a"), apart.alias("b")
    lack = -(F.col("a.slack") + F.col("b.slack"))
    once = (F.col("b.slack") >= 0) | (F.col("a.id") < F.col("b.id"))
    open_ = (lack > 0) & (2 * (s + t) * F.least("a.r", "b.r") >= lack)
    shared = F.array_intersect("a.away", "b.away")
    linked = (2 * (s + t) * F.size(shared) >= lack) & (F.get(shared, F.lit(0)) == F.col("a.w"))
    met = a.join(b, (F.col("a.near") == F.col("b.near")) & (F.col("a.w") == F.col("b.w")) & once & open_ & linked)
    return in_order(met.select(F.col("a.place").alias("at_a"), F.col("b.place").alias("at_b")))


def in_order(pairs: DataFrame) -> DataFrame:
    """``a``, ``b``: the classes at the earlier and the later place."""
    return pairs.select(F.least("at_a", "at_b")["id"].alias("a"), F.greatest("at_a", "at_b")["id"].alias("b"))


def index(sets: DataFrame) -> DataFrame:
    """The codes of the classes' prefixes, with size and place in one number. Those that stand for one occurrence in the whole corpus can
    meet nothing and are left out, and sets of one or two words are similar to no other."""
    near = F.coalesce("near", F.lit(0).cast("long")) if "near" in sets.columns else F.lit(0).cast("long")
    met = sets.where("n > 2").select("id", "n", "bits", "odd_bits", near.alias("near"), F.posexplode("prefix").alias("at", "code"))
    size_at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long"))
    return met.where(F.col("code") >= (1 << (63 - RANK_BITS - SHORT))).select("code", "id", "bits", "odd_bits", size_at.alias("size_at"), "near")


def can_link(a: str, b: str) -> Column:
    """Sizes, places in the two orders, and parities leave room for the overlap that ``b`` needs with a smaller ``a``."""
    s, t = SIMILARITY
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    size, at = (lambda c: F.shiftright(c("size_at"), 32)), (lambda c: c("size_at").bitwiseAND(F.lit(2**32 - 1)))
    total = size(x) + size(y)
    left = F.least(size(x) - at(x), size(y) - at(y))  # tokens from here on
    all_, odd = x("bits").bitwiseXOR(y("bits")), x("odd_bits").bitwiseXOR(y("odd_bits"))
    differ = F.when(size(x) >= WIDE, F.bit_count(all_.bitwiseXOR(odd)) + F.bit_count(odd)).otherwise(F.bit_count(all_))
    smaller = (size(x) < size(y)) | ((size(x) == size(y)) & (x("id") < y("id")))
    apart = (x("near") == 0) | (x("near") != y("near"))  # pairs of one group are counted there
    return smaller & apart & (t * size(x) >= s * size(y)) & ((s + t) * left >= s * total) & ((s + t) * (total - differ) >= 2 * s * total)


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs of classes that the prefix, length, positional and parity filters leave, each with one of the codes it meets at."""
    a, b = index(sets).alias("a"), index(sets).alias("b")
    met = a.join(b, (F.col("a.code") == F.col("b.code")) & can_link("a", "b"))
    return met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.min("a.code").alias("code"))


def cells(pairs: DataFrame) -> DataFrame:
    """The candidates with the cell they are confirmed in: their code, and for one of more than ``CELL_PAIRS`` candidates a share of it by
    both ends, so that the words of a line are sent once to each of few cells instead of once a pair."""
    many = pairs.groupBy("code").count().where(F.col("count") > CELL_PAIRS).select("code", F.ceil(F.sqrt(F.col("count") / CELL_PAIRS)).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    return pairs.join(many, "code", "left").select("a", "b", F.xxhash64("code", F.pmod(F.xxhash64("a"), parts), F.pmod(F.xxhash64("b"), parts)).alias("cell"))


def links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked pairs of classes that are not of one group, ``a`` before ``b``: the candidates that their words confirm."""
    s, t = SIMILARITY
    spark = docs.sparkSession
    pairs = keep_alone(cells(keep_alone(candidates(sets), "line-candidates")), "line-cells")
    ends = pairs.select("cell", F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.collect_set("cell").alias("cells"))
    chosen = keep_alone(ends.join(sets, "id").select("id", "cells", "doc", F.col("line").alias("at"), "says"), "line-chosen")
    sent = said(docs, chosen).select(F.explode("cells").alias("cell"), "id", F.struct("doc", "at", "says", "id").alias("place"), "line").repartition("cell")
    met = pairs.repartition("cell")
    for side in "ab":  # hashed, so that pairs with their words are neither sorted nor written; a cell's lines are bounded by its candidates
        words = sent.select("cell", F.col("id").alias(side), F.col("place").alias(f"at_{side}"), tokens(F.col("line")).alias(f"w_{side}"))
        met = met.join(words.hint("shuffle_hash"), ["cell", side])
    found = in_order(met.where((s + t) * F.size(F.array_intersect("w_a", "w_b")) >= s * (F.size("w_a") + F.size("w_b"))))
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # both joins stay in the cell
        return keep_alone(found.distinct(), "line-links")  # repeated rows confirm a pair again


def judge(docs: DataFrame, n_links: bool = False) -> DataFrame:
    """Every line with a word: its class (place of the first line), and whether it is kept. With ``n_links`` also the number of
    classes that its class is linked to, earlier and later ones."""
    placed, sets = classes(docs)
    members = around(docs, sets)
    grouped = members.select("id", "near")
    found = links(docs, sets.join(small(grouped, grouped.count(), BROADCAST_LINES), "id", "left")).unionByName(unsure(members))
    ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(False).alias("later")), F.struct(F.col("b").alias("id"), F.lit(True).alias("later")))).alias("e"))
    counted = ends.select("e.*").groupBy("id").agg(F.count("*").alias("n_links"), F.max("later").alias("later")).unionByName(sure(members))
    linked = counted.groupBy("id").agg(F.sum("n_links").alias("n_links"), F.max("later").alias("later"))
    known = sets.join(linked, "id", "left").select("k1", "k2", "doc", "line", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("later", F.lit(False)).alias("later"))
    first = (doc_key() == F.col("doc")) & (F.col("line_no") == F.col("line"))
    return placed.join(known, ["k1", "k2"]).select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.nullif(F.col("doc"), F.lit(FIRST).cast("long")).alias("class_doc_id"),
        F.col("line").cast("long").alias("class_line_no"),
        *([F.col("n_links").cast("long").alias("n_links")] if n_links else []),
        (first & ~F.col("later")).alias("kept"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go, with their own columns; ``n_chars`` follows the text. Rows that repeat a
    doc_id are one document, cleaned alike."""
    gone = judge(docs).where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("lines")).select(F.struct("doc_id", "lines").alias("gone"))
    left = F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains("gone.lines", i.cast("long")))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    rows = docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone.doc_id")), "left")
    out = rows.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
