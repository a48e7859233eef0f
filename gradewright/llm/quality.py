"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Each document gives a vector of transformed statistics: log words, log mean word length, and the logs of symbols,
repeated lines and repeated words in a hundred. Per language and source the mean and covariance of the
``CORE`` share of documents with the smallest determinant are sought by concentration steps from two starts (all
documents; medians and their deviations): measure all distances, keep the nearest share, estimate anew, until no group's smallest
determinant falls by more than a share ``SETTLED`` of it. A document is
rejected if its squared Mahalanobis distance is above ``CUT``, or if it fails the base rules.

A step is one aggregation of the narrow table of statistics: moments are summed by group and distance bin, and the
bins up to the wanted share make the next estimate. Sums are of integers, so reruns agree.

Defined results: a null text has no words and fails; the estimates are of documents that pass the base rules; a group
with fewer than ``LEAST`` of them uses its language's estimate, then that of all, and rejects nothing if all are too few. Null
is a language or source like any other. The variances have floors, so that a statistic that is the same for nearly
all documents rejects nobody for a trace of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh3_64_intdigest

from gradewright.llm.common import keep, small

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
NAMES = ("words", "length", "symbols", "lines", "repeats")
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SCALE = 256  # statistics are rounded to this part
FLOORS = (0.5, 0.1, 0.3, 0.6, 0.6)  # least deviations
CORE = 0.75  # share of a group that the determinant is of
SPREAD = 1.41  # that share's covariance against a whole normal one of 5 dimensions
CUT = 52.0  # squared distance; a normal vector of 5 dimensions is beyond it once in 10**9
LEAST = 40
SETTLED = 1e-3
BINS = 8  # of distance per octave
BROADCAST_MODELS = 100_000  # groups, 400 bytes each
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of 8 that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    sums = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        sums += ids[k : k + n] * np.uint64(_ODD[k])
    ordered = np.sort(sums)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(sums, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at 0x20 and 0x09-0x0D only
    blanks = sum(data.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += bool(line.strip())
        else:
            seen.add(line)
    return len(words), len(text or "") - blanks, sum(data.count(bytes([c])) for c in SYMBOLS), again, repeat_words(words)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in STATS]))
def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype="int64")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, as integers of 1/``SCALE``. Only for documents with words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    raw = [
        F.log1p(words), F.log(chars / words), F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / words), F.log1p(100 * F.col("n_repeat_words") / words),
    ]
    return [F.round(x * SCALE).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def _levels(rows: DataFrame) -> DataFrame:
    """Each row under its language and source, its language, and all: level 0, 1, 2."""
    level = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return rows.withColumn("level", level).select(
        "level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"), *[f"x{i}" for i in range(P)]
    )


GROUP = ["level", "lang", "source"]
MODEL = "level int, lang string, source string, start int, n long, mean array<double>, inverse array<double>, det double"


def moments() -> list[Column]:
    squares = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)], *squares]



def distance(mean: str, inverse: str) -> Column:
    """The squared Mahalanobis distance of x0.. from a model's arrays."""
    off = [F.col(f"x{i}") / SCALE - F.element_at(mean, i + 1) for i in range(P)]
    return sum((off[i] * off[j] * F.element_at(inverse, i * P + j + 1) * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def estimate(n: float, s: np.ndarray, ss: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and determinant from sums; variances have floors."""
    mean, cov = s / n / SCALE, np.zeros((P, P))
    for (i, j), v in zip(PAIRS, ss, strict=True):
        cov[i, j] = cov[j, i] = spread * (v / n / SCALE**2 - mean[i] * mean[j])
    cov += np.diag(np.maximum(0, np.square(FLOORS) - np.diag(cov)))
    return mean, np.linalg.inv(cov), float(np.linalg.det(cov))


def _sums(rows: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    take = lambda names: np.array([float(sum(map(int, rows[c]))) for c in names])
    return int(rows["n"].sum()), take([f"s{i}" for i in range(P)]), take([f"s{i}_{j}" for i, j in PAIRS])


def _model(rows: pd.DataFrame, start: int, total: int, mean, inverse, det) -> pd.DataFrame:
    key = {c: [rows[c].iloc[0]] for c in GROUP}
    return pd.DataFrame({**key, "start": [start], "n": [total], "mean": [list(mean)], "inverse": [list(np.ravel(inverse))], "det": [det]})


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """The two starts of a group, from one row of its moments, medians and quartiles."""
    n, s, ss = _sums(rows)
    q = np.stack([np.asarray(x, float) for x in rows["quartiles"].iloc[0]]) / SCALE  # P rows of three
    wide = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOORS)
    return pd.concat([_model(rows, 0, n, *estimate(n, s, ss, 1.0)), _model(rows, 1, n, q[:, 1], np.diag(1 / wide**2), float(np.prod(wide**2)))])


def _concentrate(rows: pd.DataFrame) -> pd.DataFrame:
    """The next estimate of a group and start, from its moments by distance bin (a few hundred bins at most)."""
    rows = rows.sort_values("bin")
    upto = rows["n"].cumsum().to_numpy()
    core = rows.iloc[: int(np.searchsorted(upto, CORE * upto[-1])) + 1]
    n, s, ss = _sums(core)
    return _model(rows, int(rows["start"].iloc[0]), int(upto[-1]), *estimate(n, s, ss, SPREAD))


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]


def models(stats: DataFrame) -> DataFrame:
    """The estimate of each group that has at least ``LEAST`` documents."""
    rows = keep(_levels(stats.where(~base_failed()).select("lang", "source", *vector())), "quality-vectors")
    quartiles = F.array(*[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000) for i in range(P)]).alias("quartiles")
    first = rows.groupBy(*GROUP).agg(*moments(), quartiles).where(F.col("n") >= LEAST)
    now, best = keep(first.groupBy(*GROUP).applyInPandas(_starts, MODEL), "quality-models"), None
    groups = now.count()
    while True:
        d2 = F.greatest(distance("m.mean", "m.inverse"), F.lit(2.0**-10))
        binned = (
            rows.alias("r")
            .join(small(now, groups, BROADCAST_MODELS).alias("m"), _same(GROUP))
            .select(*[F.col(f"r.{c}") for c in rows.columns], "m.start", F.least(F.floor(F.log2(d2) * BINS), F.lit(40 * BINS)).cast("int").alias("bin"))
        )
        summed = binned.groupBy(*GROUP, "start", "bin").agg(*moments())
        now = keep(summed.groupBy(*GROUP, "start").applyInPandas(_concentrate, MODEL), "quality-models")
        # the starts are of other shares, so the first core estimates are the first to compare
        reached = now if best is None else best.unionByName(now)
        least = keep(reached.groupBy(*GROUP, "start").agg(F.min_by(F.struct("n", "mean", "inverse", "det"), "det").alias("e")).select(*GROUP, "start", "e.*"), "quality-best")
        if best is not None:
            fell = least.alias("m").join(best.alias("r"), _same([*GROUP, "start"])).where(F.col("m.det") < F.col("r.det") * (1 - SETTLED))
            if not fell.limit(1).count():
                break
        best = least
    return keep(least.groupBy(*GROUP).agg(F.min_by(F.struct("mean", "inverse"), F.struct("det", "start")).alias("e")).select(*GROUP, "e.*"), "quality-models")


def judge(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds ``distance`` and ``kept`` to rows that have the statistics."""
    sent = small(found, found.count(), BROADCAST_MODELS)
    at = [sent.where(f"level = {k}").select(F.col("lang").alias(f"l{k}"), F.col("source").alias(f"s{k}"), F.struct("mean", "inverse").alias(f"m{k}")) for k in range(2)]
    of_all = found.where("level = 2").select(F.struct("mean", "inverse")).scalar()
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "lang", "source", *vector())
    out = out.join(at[0], F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
    out = out.join(at[1], F.col("lang").eqNullSafe(F.col("l1")), "left")
    out = out.withColumn("m", F.coalesce("m0", "m1", of_all)).withColumn("_distance", distance("m.mean", "m.inverse")).select("d.*", "_distance")
    return out.withColumn("kept", ~base_failed() & (F.coalesce("_distance", F.lit(0.0)) <= CUT))


def with_stats(docs: DataFrame) -> DataFrame:
    """The columns ``lang`` and ``source``, the whole row as ``row``, and the statistics."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(whole, "lang", "source", _stats("text").alias("_s")).select("row", "lang", "source", "_s.*")


def report(docs: DataFrame) -> DataFrame:
    """Per document: the statistics, the base verdict, the distance and the verdict."""
    stats = keep(docs.select("doc_id", "lang", "source", _stats("text").alias("_s")).select("doc_id", "lang", "source", "_s.*"), "quality-stats")
    return judge(stats, models(stats)).withColumn("base_failed", base_failed()).withColumnRenamed("_distance", "distance").drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. The texts are read twice and never shuffled."""
    found = models(docs.select("lang", "source", _stats("text").alias("_s")).select("lang", "source", "_s.*"))
    return judge(with_stats(docs), found).where("kept").select("row.*")
