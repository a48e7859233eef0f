"""Language ID by rank-order profiles.

A text's letters are lower-cased one by one, everything between words is one blank, and the grams of 1 to 3 characters of its words,
blanks at the ends included, are counted. Its profile is the ``PROFILE`` most frequent grams in order (ties: shorter
grams, then lower code points, first). A language's profile is the same over a sample of its documents. The
distance of a document to a language is the sum, over the document's grams, of how far the gram is from its place there, or
``PROFILE`` for a gram that is not there; the nearest language is predicted (ties: the first by name).

Profiles are learned from about ``SAMPLE`` documents of each language, whole texts, chosen by a seeded draw among rows whose
``crc32(doc_id) % 5`` is not 0; a language of fewer documents gives all of them. Only the profiles (``PROFILE`` rows for each
language) reach the driver. Languages are compared in blocks of ``BLOCK`` in one scan, so that no task holds more profiles than that at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when nothing could be learned; a
null lang teaches nothing, an empty one is a language of that name; a document without doc_id is not held out; repeated rows are
judged alike, and count as often as they occur when they teach; a text of any length is counted in pieces of ``PIECE`` characters;
extra columns pass through ``predict``, which replaces ``lang_pred`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.llm.common import keep, small, uniform

PROFILE = 300
SAMPLE = 2000  # documents of each language that teach, about
BLOCK = 256  # languages
LANGUAGES = 10_000  # whose sampling rates are sent to every task
PIECE = 1 << 20
SPACE, BITS = 32, 21  # three code points fit into 63 bits
UNKNOWN = "und"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def lowered(point: int) -> int:
    """The code point of a letter in lower case, 0 for what is no letter."""
    c = chr(point)
    return (ord(low) if len(low := c.lower()) == 1 else point) if c.isalpha() else 0


def letters() -> np.ndarray:
    """``lowered`` of the first 65,536 code points."""
    return np.array([lowered(p) for p in range(0x10000)], np.int64)


def coded(text: str, table: np.ndarray) -> np.ndarray:
    """Lower-case code points of letters, 0 for others."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if (far := points >= len(table)).any():
        out = table[np.where(far, 0, points)]
        rare, at = np.unique(points[far], return_inverse=True)
        out[far] = np.array([lowered(int(p)) for p in rare], np.int64)[at]
        return out
    return table[points]


def grams(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of a whole text, ascending, and their counts."""
    found, tail = [], np.array([SPACE], np.int64)
    for start in range(0, len(text), PIECE):
        c = coded(text[start : start + PIECE], table)
        if start + PIECE >= len(text):
            c = np.append(c, 0)
        c = np.concatenate([tail, np.where(c == 0, SPACE, c)])
        c = c[np.concatenate([[True], (c[1:] != SPACE) | (c[:-1] != SPACE)])]  # runs of blanks are one
        # single letters and pairs that ended before were counted with the piece before
        ones = c[len(tail) :]
        pairs = c[:-1] << BITS | c[1:]
        threes = (c[:-2] << (2 * BITS)) | (c[1:-1] << BITS) | c[2:]
        found.append(np.unique(np.concatenate([ones[ones != SPACE], pairs[len(tail) - 1 :], threes[c[1:-1] != SPACE]]), return_counts=True))
        tail = c[-2:]
    if len(found) == 1:
        return found[0]
    if not found:
        return np.array([], np.int64), np.array([], np.int64)
    codes, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([f[1] for f in found])).astype(np.int64)


def profile(text: str | None, table: np.ndarray) -> np.ndarray:
    """The most frequent grams of a text in order; none without a letter."""
    codes, counts = grams(text or "", table)
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def nearest(ranked: np.ndarray, known: np.ndarray, ranks: np.ndarray) -> tuple[int, int]:
    """Distance to, and number of, the nearest language. ``ranks``: a row for each of the sorted grams ``known``, a column for each language."""
    at = np.minimum(np.searchsorted(known, ranked), len(known) - 1)
    there = np.where((known[at] == ranked)[:, None], ranks[at], -1)
    far = np.where(there >= 0, np.abs(there - np.arange(len(ranked))[:, None]), PROFILE).sum(axis=0)
    return int(far.min()), int(far.argmin())


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang``, ``gram``, ``n``: the grams of a batch of texts, added up by language."""
    table = letters()
    for batch in batches:
        of: dict[str, list] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of.setdefault(lang, []).append(grams(text, table))
        for lang, parts in of.items():
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """The profile of every language by name."""
    taught = docs.where(~held_out()).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    shares = keep(taught.groupBy("lang").agg((F.lit(float(SAMPLE)) / F.count("*")).alias("share")), "language-shares")
    draw = uniform(F.lit("language"), F.col("doc_id"), F.crc32(F.col("text").cast("binary")))
    sample = taught.join(small(shares, shares.count(), LANGUAGES), "lang").where(draw < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("place", place).where(F.col("place") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "place").collect():  # PROFILE rows for each language
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


def compared(names: list[str], profiles: dict[str, list[int]]):
    """An Arrow function from a text to the distance, name and number of grams for a block of languages."""
    known = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in names]))
    ranks = np.full((len(known), len(names)), -1, np.int64)
    for j, name in enumerate(names):
        ranks[np.searchsorted(known, profiles[name]), j] = np.arange(len(profiles[name]))

    @F.pandas_udf("distance long, lang string, n int")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = letters()
        for texts in batches:
            rows = []
            for text in texts:
                ranked = profile(text, table)
                far, j = nearest(ranked, known, ranks) if len(ranked) else (None, None)
                rows.append((far, names[j] if j is not None else None, len(ranked)))
            yield pd.DataFrame({"distance": pd.array([r[0] for r in rows], "Int64"), "lang": [r[1] for r in rows], "n": [r[2] for r in rows]})

    return judged


def predict(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """Adds ``lang_pred`` and ``score``: 1 for equal profiles, 0 where no gram is shared."""
    names = sorted(profiles)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not names:
        return docs.select(*rest, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    blocks = [compared(names[i : i + BLOCK], profiles)(docs["text"]) for i in range(0, len(names), BLOCK)]
    whole = docs.select(F.struct(*rest).alias("row"), F.array(*blocks).alias("found"))
    best = whole.select("row", F.array_min("found").alias("best"))  # the first by name of the nearest, as names are in order
    sure = F.col("best.lang").isNotNull()
    score = 1 - F.col("best.distance") / (F.col("best.n") * F.lit(float(PROFILE)))
    return best.select("row.*", F.when(sure, F.col("best.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(sure, score).otherwise(0.0).alias("score"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: whether it is held out from learning, its language and how near it is."""
    found = predict(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
