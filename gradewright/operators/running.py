"""Running totals and carried values that do not need one task per group.

A window over ``partitionBy(group).orderBy(position)`` sorts and scans a whole
group in a single task, which fails when one log, batch or exam holds a third of
the rows. Here the rows of a group are cut into chunks of consecutive positions
and dealt out by chunk:

1. a window inside each chunk gives the value local to the chunk,
2. each chunk is summarised,
3. the summaries, up to 2**bits times fewer, are carried forward,
4. the carried value is joined back on the chunk key, by which the rows are
   already dealt out.

Both readers of the dealt rows ask for the same columns, so Spark computes the input and its
exchange once (``_witness``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewright.session import dealt


@dataclass(frozen=True)
class Measure:
    """``kind`` is ``sum`` or ``last`` (latest non-null value).

    ``inclusive`` counts the current row; ``backward`` looks at the rows after it.
    """

    name: str
    kind: str
    value: Column
    inclusive: bool = True
    backward: bool = False

    @property
    def slot(self) -> str:
        return f"_v_{self.name}"

    @property
    def carry(self) -> str:
        return f"_p_{self.name}"


def _over(m: Measure, keys: Sequence[str], order: str, upto: int) -> Column:
    direction = F.col(order).desc() if m.backward else F.col(order).asc()
    w = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, upto)
    value = F.col(m.slot)
    return F.sum(value).over(w) if m.kind == "sum" else F.last(value, ignorenulls=True).over(w)


def _summary(m: Measure, order: str) -> Column:
    value = F.col(m.slot)
    if m.kind == "sum":
        return F.sum(value).alias(m.slot)
    at = F.when(value.isNotNull(), F.col(order))
    return (F.min_by(value, at) if m.backward else F.max_by(value, at)).alias(m.slot)


def _joined(m: Measure, near: Column, far: Column) -> Column:
    if m.kind == "sum":
        return F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0))
    return F.coalesce(near, far)


GROUP = "_group"


def _group(by: Sequence[str]) -> list[Column]:
    """The key of a group as one struct, so that nulls join like values; none without ``by``."""
    return [F.struct(*by)] if by else []


def _chunk_of(order: Column, bits: int) -> Column:
    """Positions are never null; saying so keeps null filters, which would make the two readers of the dealt rows differ, out of the plan."""
    return F.coalesce(F.shiftright(order.cast("bigint"), bits), F.lit(0).cast("bigint"))


def _hash(df: DataFrame) -> Column:
    return F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind])


def _witness(df: DataFrame) -> Column:
    """An aggregate over all columns, never null. A summary that keeps it reads the same columns of the dealt rows as
    the rows' own branch does, and Spark then reuses the exchange instead of computing the input again."""
    return F.max(_hash(df))


def _whole(df: DataFrame) -> Column:
    """Holds for every row, but asks for all columns, so that the rows' own branch is not pruned below what the summary reads."""
    return F.nullif(_hash(df), _hash(df) + 1).isNotNull()


def running(
    df: DataFrame, order: str, measures: Sequence[Measure], by: Sequence[str] = (), bits: int = 16, levels: int = 1
) -> DataFrame:
    """Add one column per measure, carried along ``order`` inside each ``by`` group.

    ``order`` is a whole-number column, unique within a group and never null; a null in ``by`` is a value. A chunk covers
    2**bits consecutive positions. All columns of ``df`` travel: select what is needed before. The summaries of a group's chunks meet in one task; where positions are so sparse that they are many,
    more ``levels`` carry them in chunks of chunks.
    """
    key, chunk = _group(by), f"_chunk{levels}"
    slots = [*[c.alias(GROUP) for c in key], *[m.value.alias(m.slot) for m in measures]]
    by = [GROUP] if key else []
    slotted = df.select("*", *slots, _chunk_of(F.col(order), bits).alias(chunk)).repartition(*by, chunk)

    summed = slotted.groupBy(*by, chunk).agg(*[_summary(m, order) for m in measures], _witness(slotted).alias("_seen"))
    chunks = summed.where(F.col("_seen").isNotNull()).drop("_seen")
    before = [Measure(m.carry, m.kind, F.col(m.slot), False, m.backward) for m in measures]
    if levels > 1:
        carried = running(chunks.withColumnRenamed(GROUP, "_of"), chunk, before, ["_of"] if by else [], bits, levels - 1).withColumnRenamed("_of", GROUP)
    else:
        carried = chunks.withColumns({m.carry: _over(m, by, chunk, -1) for m in measures})
    carry = carried.select(*by, chunk, *[m.carry for m in measures])

    local = slotted.withColumns(
        {f"_l_{m.name}": _over(m, [*by, chunk], order, 0 if m.inclusive else -1) for m in measures}
    )
    out = local.where(_whole(slotted)).join(carry, [*by, chunk])
    return out.select(
        *df.columns,
        *[_joined(m, F.col(f"_l_{m.name}"), F.col(m.carry)).alias(m.name) for m in measures],
    )


def segments(
    df: DataFrame,
    order: str,
    value: Column,
    here: Column,
    starts: Callable[[Column, Column], Column],
    name: str,
    by: Sequence[str] = (),
    bits: int = 16,
) -> DataFrame:
    """Number the segments of each group along ``order``: a row opens one where ``starts(value of the row before, here)`` holds; the
    value before the first row is null. Looking back and counting take one pass: only the first row of a chunk asks the chunk before.
    """
    key = _group(by)
    by = [GROUP] if key else []
    slots = [*[c.alias(GROUP) for c in key], value.alias("_value"), here.alias("_here"), _chunk_of(F.col(order), bits).alias("_chunk")]
    slotted = df.select("*", *slots).repartition(*by, "_chunk")
    w = Window.partitionBy(*by, "_chunk").orderBy(order)
    opens = F.when(F.row_number().over(w) > 1, starts(F.lag("_value").over(w), F.col("_here")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    flagged = slotted.withColumn("_opens", opens)

    chunks = flagged.groupBy(*by, "_chunk").agg(
        F.sum("_opens").alias("_n"), F.min_by("_here", order).alias("_first"), F.max_by("_value", order).alias("_last"), _witness(slotted).alias("_seen")
    ).where(F.col("_seen").isNotNull())
    line = Window.partitionBy(*by).orderBy("_chunk")
    joint = chunks.withColumn("_open1", starts(F.lag("_last").over(line), F.col("_first")).cast("bigint"))
    upto = F.sum(F.col("_n") + F.col("_open1")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    carry = joint.select(*by, "_chunk", (F.coalesce(upto, F.lit(0)) + F.col("_open1")).alias("_carry"))

    counted = flagged.withColumn("_local", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where(_whole(slotted)).join(carry, [*by, "_chunk"]).select(*df.columns, (F.col("_local") + F.col("_carry")).alias(name))


def ordered_key(value: str, kind: str) -> Column:
    """A whole number of 64 bits that orders like the value: doubles by their bits, negative ones reversed."""
    if kind not in ("double", "float"):
        return F.col(value).cast("bigint")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value).cast("double") + 0.0).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(2**63 - 1)))


def order_statistics(
    df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str] = (), bits: int = 42
) -> DataFrame:
    """Exact order statistics of every group: ``n``, ``total``, ``highest``, and the values at ``ranks`` (of n, from 1).

    Radix selection on counts of distinct values (combined before the shuffle): values are counted by the leading bits of their ordered
    key, the counts (at most 2**(64-bits) a group) are added up in order, and only the buckets with a wanted rank are sorted.
    """
    names, key = list(by), _group(by)
    by = [GROUP] if key else []
    bucket = _chunk_of(ordered_key(value, dict(df.dtypes)[value]), bits).alias("_bucket")
    counts = df.where(F.col(value).isNotNull()).groupBy(*[c.alias(GROUP) for c in key], value).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.select(*by, value, "_n", bucket).repartition(*by, "_bucket")
    per = dealt.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_m"), F.sum(F.col(value) * F.col("_n")).alias("_sum"), F.max(value).alias("_max"))
    line, group = Window.partitionBy(*by).orderBy("_bucket"), Window.partitionBy(*by)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    placed = per.select(
        *by, "_bucket", "_m", (F.sum("_m").over(upto) - F.col("_m")).alias("_before"),
        F.sum("_m").over(group).alias("n"), F.sum("_sum").over(group).alias("total"), F.max("_max").over(group).alias("highest"),
    )
    wanted = {name: rank(F.col("n")).cast("bigint") for name, rank in ranks.items()}
    hits = F.lit(False)
    for rank in wanted.values():
        hits = hits | ((rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_m")))
    picked = placed.where(hits).drop("_m")
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.join(picked, [*by, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    at = [F.min(F.when(F.col("_upto") >= rank, F.col(value))).alias(name) for name, rank in wanted.items()]
    out = found.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("n", "total", "highest")], *at)
    stats = ["n", "total", "highest", *ranks]
    return out.where(F.col("n").isNotNull()).select(*[F.col(f"{GROUP}.{c}").alias(c) for c in names], *stats)


def row_numbers(df: DataFrame, order: str, name: str, by: Sequence[str] = (), bits: int = 16) -> DataFrame:
    """1-based row number along ``order`` inside each group."""
    return running(df, order, [Measure(name, "sum", F.lit(1).cast("bigint"))], by, bits)


def surrogate_ids(df: DataFrame, key: str, name: str, start: int | Column = 0, rows: int = 0) -> DataFrame:
    """Consecutive ids ``start + 1 ..`` for distinct text keys.

    The keys are spread over 65,536 hash buckets, numbered inside their bucket,
    and shifted by the sizes of the buckets before; only the bucket sizes, a
    fixed number of rows, meet in one task. ``rows``, about how many keys there are, bounds the rows of a task (``session.dealt``).
    """
    first = start if isinstance(start, Column) else F.lit(start)
    bucketed = df.withColumn("_bucket", F.substring(F.md5(F.col(key)), 1, 4))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(key)
    return (
        dealt(bucketed, ["_bucket"], rows).withColumn("_at", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn(name, (first + F.col("_before") + F.col("_at")).cast("bigint"))
        .drop("_bucket", "_before", "_at")
    )
