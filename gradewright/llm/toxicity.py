"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

A window of ``WINDOW`` bytes that holds toxic phrases compresses better with the toxic dictionary. The dictionaries are
trained on separate samples: windows of ordinary documents, and the stretches of toxic documents made of byte grams that
are much more frequent there than in ordinary documents. Toxic documents are mostly ordinary language, so the toxic
compressor gets the ordinary dictionary too, behind which its own stands; the two lengths of a window then differ by what
is particular to toxic text. A document's share and number of windows that gain ``GAINS`` bytes or more, over its whole text,
go through a logistic calibration on labelled documents that no dictionary has seen.

Labels are learned only from rows whose ``crc32(doc_id) % 5`` is not 0. The fit sees a bounded sample of rows: ``TOXIC`` and
``ORDINARY`` labelled documents with the lowest seeded draws, their texts whole: grams are counted over all of them in Spark, and the dictionaries
are trained on about ``WINDOWS`` pieces of each kind, drawn by a seed from all pieces of all these texts. Every document is scored whole.

Defined results: a null text is an empty one; an empty text is one empty window and has a score; a document without doc_id
counts as not held out; without labels of both classes every score is 0; repeated label rows count once (toxic if
one is); repeated rows of a sampled document teach once; texts of any length teach whole; extra columns pass through ``score``, which
replaces the column ``score``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from xxhash import xxh3_64_intdigest

from gradewright.llm.common import keep, uniform

TOXIC, ORDINARY = 2000, 4000
PIECE, WINDOWS = 256, 40_000  # bytes of a piece that trains a dictionary; pieces of each kind
MARKED = 100_000  # most frequent marked grams that are used
WINDOW, STEP = 64, 32  # bytes
GAINS = (2, 3)  # bytes saved by the toxic dictionary
GRAM, OFTEN, TIMES = 5, 0.01, 8  # bytes; share of toxic documents; against the share of ordinary ones
ORDINARY_SIZE, TOXIC_SIZE, LEVEL = 65_536, 4096, 3
LEARN = 0.6  # of the sample trains the dictionaries, the rest calibrates


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; samples that are too few for training are the dictionary's content as they are."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(is_toxic, text) to the grams of whole texts with the number of toxic and of ordinary ones that have them, added up by batch."""
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for is_toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            seen[is_toxic].update({data[i : i + GRAM] for i in range(len(data) - GRAM + 1)})
        grams = list(seen[0].keys() | seen[1].keys())
        counts = [pa.array([seen[kind][g] for g in grams], pa.int64()) for kind in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(grams, pa.binary()), *counts], ["gram", "toxic", "ordinary"])


def marked_grams(texts: DataFrame, toxic: int, ordinary: int) -> set[bytes]:
    """Grams in at least ``OFTEN`` of the toxic texts, ``TIMES`` as often as in the ordinary ones; ``MARKED`` at most, by frequency."""
    counted = texts.mapInArrow(gram_counts, "gram binary, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("here"), F.sum("ordinary").alias("there"))
    often = counted.where((F.col("here") >= max(3, OFTEN * toxic)) & (F.col("here") * ordinary >= TIMES * (F.col("there") + 1) * toxic))
    return {bytes(r["gram"]) for r in often.orderBy(F.desc("here"), "gram").limit(MARKED).collect()}


def drawn_pieces(texts: DataFrame, marked: set[bytes] | None, seed: str) -> list[bytes]:
    """About ``WINDOWS`` pieces of whole texts, or of the stretches that marked grams cover, by a draw on their content and place."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                data = data if marked is None else stretches(data, marked)
                out += [(data[i : i + PIECE], xxh3_64_intdigest(data[i : i + PIECE] + seed.encode(), i) / 2**64) for i in range(0, len(data), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([u for _, u in out], pa.float64())], ["piece", "draw"])

    pieces = keep(texts.select("text").mapInArrow(cut, "piece binary, draw double"), "toxicity-pieces")
    share = WINDOWS / max(1, pieces.count())
    return [bytes(r["piece"]) for r in pieces.where(F.col("draw") < share).orderBy("draw", "piece").collect()]


def stretches(text: bytes, marked: set[bytes]) -> bytes:
    """The parts of a text that marked grams cover."""
    cover = np.zeros(len(text), bool)
    for i in range(len(text) - GRAM + 1):
        if text[i : i + GRAM] in marked:
            cover[i : i + GRAM] = True
    return np.frombuffer(text, np.uint8)[cover].tobytes()


def compressors(model: Model) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    lean = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    return tuple(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **lean) for d in (model.ordinary, model.ordinary + model.toxic))


def features(text: str | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> list[float]:
    """For each gain: the share of windows with it, and the logarithm of their number."""
    data = (text or "").encode("utf-8", "surrogatepass")
    windows = [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]
    saved = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows])
    out = []
    for gain in GAINS:
        n = int((saved >= gain).sum())
        out += [np.sqrt(n / len(windows)), np.log1p(n)]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (constant first) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def with_features(docs: DataFrame, model: Model) -> DataFrame:
    @F.pandas_udf(ArrayType(DoubleType()))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ordinary, toxic = compressors(model)
        for texts in batches:
            yield pd.Series([features(t, ordinary, toxic) for t in texts], dtype=object)

    return docs.withColumn("_features", measured("text"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on the bounded sample of labelled rows."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = uniform(F.lit("toxicity"), F.col("doc_id"))
    parts = [known.where(w).orderBy(draw, "doc_id").limit(n) for w, n in (("toxic = 1", TOXIC), ("toxic <> 1", ORDINARY))]
    sample = parts[0].unionByName(parts[1])
    ids = [(r["doc_id"], int(r["toxic"] == 1)) for r in sample.collect()]  # TOXIC + ORDINARY rows at most
    if len({t for _, t in ids}) < 2:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "id long, is_toxic int"))
    sampled = docs.join(chosen, F.col("doc_id") == F.col("id")).select("is_toxic", F.coalesce("text", F.lit("")).alias("text"), (uniform(F.lit("learn"), F.col("doc_id")) < LEARN).alias("learn"))
    texts = keep(sampled, "toxicity-sample")
    learned = keep(texts.where("learn AND length(text) > 0").select("is_toxic", "text").distinct(), "toxicity-learned")
    counts = {r["is_toxic"]: r["n"] for r in learned.groupBy("is_toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return None
    toxic, ordinary = learned.where("is_toxic = 1"), learned.where("is_toxic = 0")
    marked = marked_grams(learned, counts[1], counts[0])
    particular = drawn_pieces(toxic, marked, "toxic") or drawn_pieces(toxic, None, "toxic")
    model = Model(dictionary(drawn_pieces(ordinary, None, "ordinary"), ORDINARY_SIZE), dictionary(particular, TOXIC_SIZE), ())
    measured = with_features(texts.where("NOT learn"), model).select("is_toxic", "_features").distinct().orderBy("is_toxic", "_features").collect()
    y = np.array([r["is_toxic"] for r in measured], float)
    if len(set(y)) < 2:
        return None
    return Model(model.ordinary, model.toxic, tuple(logistic(np.array([r["_features"] for r in measured]), y)))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds ``score``, 0 to 1. A column of that name is replaced."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    linear = sum((F.element_at("_features", i + 1) * float(w) for i, w in enumerate(model.weights[1:])), F.lit(float(model.weights[0])))
    return with_features(docs, model).withColumn("score", 1 / (1 + F.exp(-linear))).drop("_features")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it is held out from learning, its score and the predicted label."""
    scored = score(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
