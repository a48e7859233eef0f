"""Page streams: cut a batch of scanned pages into students.

The cut is a left-to-right fold over the pages of a batch: page 1 opens a
student, an unmarked page opens one when none is open or the open one is full, any
other marked page joins the open student or is dropped. The fold's only memory
is the number of pages of the open student, and beyond "full" the number no
longer matters, so a run of pages is a function on the states 0 (none open) .. n
(full). Such functions compose: runs of 256 pages are folded on their own, for
every state they might be entered with, then the runs are chained in levels of
256. No task ever holds more than 256 entries, however large a batch is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewright.functions.collections import record
from gradewright.functions.text import marker_page

BITS = 8
LEVELS = 3  # 256**3 pages per top entry; page_idx is an int, so at most 128 of them

_STATE = "struct<opened:int,pages:bigint,held:int>"


def _start(held: Column) -> Column:
    """opened: students opened in the run; pages: pages of the open student that
    lie in the run; held: size of the open student, capped at n."""
    return record(opened=F.lit(0), pages=F.lit(0).cast("bigint"), held=held.cast("int"))


def _state(opened: Column, pages: Column, held: Column) -> Column:
    return record(opened=opened, pages=pages.cast("bigint"), held=held.cast("int"))


def _opens(page: Column, held: Column, n: Column) -> Column:
    return F.coalesce(page == 1, F.lit(False)) | (page.isNull() & ((held == 0) | (held >= n)))


def _step(acc: Column, page: Column, n: Column) -> Column:
    held = acc["held"]
    return (
        F.when(_opens(page, held, n), _state(acc["opened"] + 1, F.lit(1), F.lit(1)))
        .when(held > 0, _state(acc["opened"], acc["pages"] + 1, F.least(held + 1, n)))
        .otherwise(acc)
    )


def _after(acc: Column, run: Column, n: Column) -> Column:
    """State after a whole run, given the run's outcome per entry state."""
    outcome = F.get(run["outcome"], acc["held"])
    held = acc["held"]
    return F.when(
        outcome["opened"] > 0,
        _state(acc["opened"] + outcome["opened"], outcome["pages"], F.least(outcome["pages"], n)),
    ).otherwise(
        _state(
            acc["opened"],
            acc["pages"] + outcome["pages"],
            F.when(held > 0, F.least(held + outcome["pages"], n)).otherwise(F.lit(0)),
        )
    )


def _outcomes(items: Column, first: Column, n: Column, step) -> Column:
    """Outcome for every entry state; the first run of a batch is entered closed."""
    states = F.sequence(F.lit(0), F.when(first, F.lit(0)).otherwise(n))
    return F.transform(states, lambda s: F.aggregate(items, _start(s), lambda acc, x: step(acc, x, n)))




def split_pages(
    pages: DataFrame,
    pages_per_exam: int | Column = 1,
    batch: str = "batch_id",
    order: str = "page_idx",
    marker: str = "qr_text",
    bits: int = BITS,
) -> DataFrame:
    """(batch, student_idx, page_idx, exam_page_num, qr_text) for every kept page.

    ``pages_per_exam`` may be a column when batches belong to different exams. A
    batch in which nothing opens a student (all pages marked, none is page 1) is
    cut into chunks of n pages by position.
    """
    size = pages_per_exam if isinstance(pages_per_exam, Column) else F.lit(pages_per_exam)
    size = F.greatest(F.coalesce(size.cast("int"), F.lit(1)), F.lit(1))

    runs = (
        pages.select(
            F.col(batch).alias("b"),
            F.col(order).cast("bigint").alias("i"),
            F.col(marker).alias("qr"),
            size.alias("n"),
        )
        .where(F.col("b").isNotNull())
        .withColumn("c0", F.shiftright("i", bits))
        .groupBy("b", "c0")
        .agg(
            F.max("n").alias("n"),
            F.array_sort(
                F.collect_list(F.struct("i", marker_page("qr").alias("page"), F.col("qr")))
            ).alias("items"),
        )
    )
    n = F.col("n")

    # upwards: outcomes of longer and longer runs
    levels = [
        runs.select(
            "b", "c0", "n", "items",
            F.size("items").cast("bigint").alias("rows"),
            _outcomes(F.col("items"), F.col("c0") == 0, n, lambda a, x, k: _step(a, x["page"], k)).alias(
                "outcome"
            ),
        )
    ]
    for level in range(1, LEVELS):
        below, c, d = levels[-1], f"c{level - 1}", f"c{level}"
        members = below.groupBy("b", F.shiftright(c, bits).alias(d)).agg(
            F.max("n").alias("n"),
            F.sum("rows").alias("rows"),
            F.array_sort(
                F.collect_list(F.struct(F.col(c).alias("c"), F.col("rows"), F.col("outcome")))
            ).alias("items"),
        )
        levels.append(
            members.withColumn("outcome", _outcomes(F.col("items"), F.col(d) == 0, n, _after))
        )

    # the top: one row per batch
    last = f"c{LEVELS - 1}"
    top = levels[-1].groupBy("b").agg(
        F.max("n").alias("n"),
        F.array_sort(
            F.collect_list(F.struct(F.col(last).alias("c"), F.col("rows"), F.col("outcome")))
        ).alias("items"),
    )

    # downwards: the state each run is entered with
    def entries(holder: DataFrame, entry: Column, rank: Column, opened_any: Column) -> DataFrame:
        nothing = F.array().cast(f"array<struct<c:bigint,at:{_STATE},rank:bigint>>")
        zero = record(at=entry, rank=rank, out=nothing)

        def walk(acc: Column, run: Column) -> Column:
            row = record(c=run["c"], at=acc["at"], rank=acc["rank"])
            return record(
                at=_after(acc["at"], run, n),
                rank=acc["rank"] + run["rows"],
                out=F.concat(acc["out"], F.array(row)),
            )

        walked = holder.withColumn("walk", F.aggregate("items", zero, walk))
        return walked.select(
            "b", opened_any.alias("any"), F.explode_outer("walk.out").alias("e")
        )

    closed = _start(F.lit(0))
    rank0 = F.lit(0).cast("bigint")
    final = F.aggregate("items", closed, lambda acc, run: _after(acc, run, n))
    entered = entries(top, closed, rank0, final["opened"] > 0)
    for level in range(LEVELS - 1, 0, -1):
        key = f"c{level}"
        at = entered.select(
            "b", F.col("e.c").alias(key), F.col("e.at").alias("at"), F.col("e.rank").alias("rank0"), "any"
        )
        holder = levels[level].select("b", key, "n", "items").join(at, ["b", key], "left")
        entered = entries(holder, F.col("at"), F.col("rank0"), F.col("any"))
    at = entered.select(
        "b", F.col("e.c").alias("c0"), F.col("e.at").alias("at"), F.col("e.rank").alias("rank0"), "any"
    )
    # left joins and outer explodes: the inner forms push a different null check into
    # each use of the runs, and then the pages are read and shuffled once per use
    located = runs.join(at, ["b", "c0"], "left")

    # inside a run: one output row per page
    out_type = "array<struct<i:bigint,qr:string,opened:int,pages:bigint,page:int>>"
    begin = record(at=F.col("at"), out=F.array().cast(out_type))

    def place(acc: Column, page: Column) -> Column:
        after = _step(acc["at"], page["page"], n)
        row = record(
            i=page["i"],
            qr=page["qr"],
            opened=after["opened"],
            pages=F.when(after["held"] > 0, after["pages"]).otherwise(F.lit(0)).cast("bigint"),
            page=page["page"],
        )
        return record(at=after, out=F.concat(acc["out"], F.array(row)))

    placed = located.select(
        "b", "n", "any", "rank0", F.posexplode_outer(F.aggregate("items", begin, place)["out"]).alias("pos", "p")
    )
    position = F.col("rank0") + F.col("pos")  # 0-based place in the batch
    number = F.coalesce(F.nullif(F.col("p.page"), F.lit(0)).cast("bigint"), F.col("p.pages"))
    by_rank = position % n + 1
    return placed.where(~F.col("any") | (F.col("p.pages") > 0)).select(
        F.col("b").alias(batch),
        F.when(F.col("any"), F.col("p.opened") - 1).otherwise(F.floor(position / n)).cast("int").alias("student_idx"),
        F.col("p.i").cast("int").alias(order),
        F.when(F.col("any"), number).otherwise(by_rank).cast("int").alias("exam_page_num"),
        F.when(F.col("any"), F.col("p.qr")).alias(marker),
    )


def first_scan_per_page(student_pages: DataFrame, keys=("batch_id", "student_idx")) -> DataFrame:
    """Of repeated exam pages of a student the first scan is the one that is read."""
    group = [*keys, "exam_page_num"]
    rest = [c for c in student_pages.columns if c not in group]
    first = student_pages.groupBy(*group).agg(F.min_by(F.struct(*rest), "page_idx").alias("_p"))
    return first.select(*group, "_p.*").select(*student_pages.columns)


def pages_in_map(student_pages: DataFrame, map_pages: DataFrame, on=("exam_id",)) -> DataFrame:
    """Pages that the exam map knows; page n of a student is map page n-1."""
    known = map_pages.withColumn("exam_page_num", F.col("page_index") + 1)
    return student_pages.join(known, [*on, "exam_page_num"])


def last_page_wins(results: DataFrame, keys, order: str = "page_idx") -> DataFrame:
    """A question found on several pages keeps the result of the last page."""
    rest = [c for c in results.columns if c not in keys]
    best = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return best.select(*keys, "r.*")


def zip_by_position(scans: DataFrame, map_pages: DataFrame, scan_order: str, map_order: str) -> DataFrame:
    """Pair scanned and mapped pages by their position; the longer side is cut."""
    from gradewright.operators.running import row_numbers

    left = row_numbers(scans, scan_order, "position")
    right = row_numbers(map_pages, map_order, "position")
    return left.join(right, "position")
