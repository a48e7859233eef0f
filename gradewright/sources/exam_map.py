"""Exam maps: the JSON document and the dimensions taken from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.functions.collections import allowed_letters, record
from gradewright.functions.geometry import anchor_centre, number_region
from gradewright.functions.numeric import safe_double
from gradewright.functions.text import first_known
from gradewright.schemas import BOX, EXAM_MAP


def read_exam_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXAM_MAP).option("multiLine", True).json(path)


def maps_from_text(lines: DataFrame, text: str = "value") -> DataFrame:
    """Exam maps that arrive as one JSON text each."""
    return lines.select(F.from_json(text, EXAM_MAP).alias("m")).select("m.*")


def map_pages(maps: DataFrame) -> DataFrame:
    """One row per map page."""
    return maps.select(
        first_known("examId").alias("exam_id"), F.posexplode("pages").alias("page_pos", "p")
    ).select(
        "exam_id",
        "page_pos",
        F.coalesce("p.pageIndex", "page_pos").alias("page_index"),
        F.col("p.pageId").alias("page_id"),
        F.col("p.pageWidth").alias("page_width"),
        F.col("p.pageHeight").alias("page_height"),
        F.col("p.anchors").alias("anchors"),
        F.col("p.studentNumberRegion").alias("number_region"),
        F.col("p.studentNumberBoxes").alias("number_boxes"),
        F.col("p.questions").alias("questions"),
    )


def _questions(maps: DataFrame) -> DataFrame:
    return map_pages(maps).select("exam_id", "page_pos", F.explode("questions").alias("q_num", "q"))


def question_dimension(maps: DataFrame) -> DataFrame:
    """The answer key: one row per question, the last page that has it wins."""
    q = F.col("q")
    rows = _questions(maps).select(
        "exam_id",
        "q_num",
        "page_pos",
        F.struct(
            "page_pos",
            F.coalesce(q["type"], F.lit("unknown")).alias("q_type"),
            q["questionText"].alias("question_text"),
            safe_double(q["scoring"]["points"]).alias("points"),
            safe_double(q["scoring"]["penaltyPerItem"]).alias("penalty"),
            q["scoring"]["itemCount"].alias("item_count"),
            q["expectedAnswer"].alias("expected"),
        ).alias("d"),
    )
    best = rows.groupBy("exam_id", "q_num").agg(F.max_by("d", "page_pos").alias("d"))
    return best.select("exam_id", "q_num", "d.*")


def expected_cells(dimension: DataFrame) -> DataFrame:
    """Expected items of matching and fill-in questions."""
    e = F.col("expected")
    key = F.when(F.col("q_type") == "matching", e["correctMatches"]).when(
        F.col("q_type") == "fill_blanks", e["correctBlanks"]
    )
    return dimension.select("exam_id", "q_num", F.explode(key).alias("item", "expected"))


def letter_sets(dimension: DataFrame) -> DataFrame:
    """Letters that may occur in a matching question; null = any."""
    return dimension.where(F.col("q_type") == "matching").select(
        "exam_id", "q_num", allowed_letters(F.col("expected.correctMatches")).alias("allowed")
    )


def expected_answer(q_type, expected) -> Column:
    """The one field of the key that counts for a question type."""
    t, e = F.col(q_type), F.col(expected)
    none_map = F.lit(None).cast("map<string,string>")
    return record(
        option=F.when(t == "multiple_choice", e["correctOption"]),
        matches=F.when(t == "matching", F.coalesce(e["correctMatches"], F.create_map().cast("map<string,string>"))).otherwise(none_map),
        blanks=F.when(t == "fill_blanks", F.coalesce(e["correctBlanks"], F.create_map().cast("map<string,string>"))).otherwise(none_map),
        text=F.when(t == "open_ended", F.coalesce(e["text"], F.lit(""))),
    )


def box_dimension(maps: DataFrame) -> DataFrame:
    """Every box of a map: exam_id, page_pos, q_num, kind, item, box. A page's boxes are listed in its row, in one pass over the maps."""
    none = F.lit(None).cast("string")

    def one(kind: str, box: Column, q_num: Column = none) -> Column:
        return F.array(record(q_num=q_num, kind=F.lit(kind), item=none, box=box.cast(BOX)))

    def many(kind: str, boxes: Column, only: Column, q_num: Column) -> Column:
        found = F.transform(F.map_entries(boxes), lambda b: record(q_num=q_num, kind=F.lit(kind), item=b["key"], box=b["value"].cast(BOX)))
        return F.when(only, found)

    def of_question(entry: Column) -> Column:
        """All boxes of one question in one array; a question has a few dozen."""
        n, v = entry["key"], entry["value"]
        kind = lambda *types: F.coalesce(v["type"].isin(*types), F.lit(False))
        parts = [
            one("question", v["boundingBox"], n),
            many("option", v["options"], kind("multiple_choice", "multi_select"), n),
            F.when(kind("open_ended"), one("solution", v["solutionArea"], n)),
            F.when(kind("matching", "fill_blanks"), one("section", v["answerSection"], n)),
            many("answer", v["answerBoxes"], kind("matching", "fill_blanks"), n),
            many("blank", v["fillBlanks"], kind("fill_blanks"), n),
        ]
        empty = F.array().cast(f"array<struct<q_num:string,kind:string,item:string,box:{BOX}>>")
        return F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))

    digits = F.transform("number_boxes", lambda b, i: record(q_num=none, kind=F.lit("digit"), item=(i + 1).cast("string"), box=b.cast(BOX)))
    region = one("number_region", F.coalesce(F.col("number_region"), number_region("number_boxes").cast(BOX)))
    empty = F.array().cast(f"array<struct<q_num:string,kind:string,item:string,box:{BOX}>>")
    asked = F.flatten(F.transform(F.map_entries("questions"), of_question))
    boxes = F.concat(region, F.coalesce(digits, empty), F.coalesce(asked, empty))
    out = map_pages(maps).select("exam_id", "page_pos", F.explode(boxes).alias("b")).select("exam_id", "page_pos", "b.*")
    return out.where(F.col("box").isNotNull())


def anchor_dimension(maps: DataFrame) -> DataFrame:
    return map_pages(maps).select(
        "exam_id", "page_pos", F.explode("anchors").alias("corner", "a")
    ).select("exam_id", "page_pos", "corner", anchor_centre("a").alias("at"), F.col("a.diameter").alias("diameter"))
