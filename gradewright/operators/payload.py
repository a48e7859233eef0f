"""Result payload: drop image fields, normalise into relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.functions.collections import mean_of_map, record
from gradewright.functions.numeric import safe_double
from gradewright.functions.text import first_known
from gradewright.operators.judging import is_correct, review_in_store
from gradewright.settings import DEFAULTS, IMAGE_FIELDS, Thresholds


def _is_image(name: str) -> bool:
    return name in IMAGE_FIELDS or name.lower().endswith("image")


def _touches_image(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_is_image(f.name) or _touches_image(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _touches_image(dtype.elementType)
    return isinstance(dtype, T.MapType)


def _without_images(col: Column, dtype: T.DataType) -> Column:
    if not _touches_image(dtype):
        return col
    if isinstance(dtype, T.StructType):
        parts: list[Column] = []
        for f in dtype.fields:
            if not _is_image(f.name):
                parts += [F.lit(f.name), _without_images(col[f.name], f.dataType)]
        return F.when(col.isNotNull(), F.named_struct(*parts))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _without_images(x, dtype.elementType))
    if isinstance(dtype.keyType, T.StringType):
        keep = F.map_filter(
            col, lambda k, v: ~k.isin(*IMAGE_FIELDS) & ~F.lower(k).endswith("image")
        )
        if _touches_image(dtype.valueType):
            keep = F.transform_values(keep, lambda k, v: _without_images(v, dtype.valueType))
        return keep
    return col


def strip_images(df: DataFrame) -> DataFrame:
    """Drop every field or map key that names an image, at any depth."""
    return df.select(
        *[
            _without_images(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            for f in df.schema.fields
            if not _is_image(f.name)
        ]
    )


def question_confidence(q: Column) -> Column:
    """Own confidence, else the mean of the cells, else 0."""
    return F.coalesce(
        F.when(q["confidence"].isNotNull(), safe_double(q["confidence"])),
        mean_of_map(q["ocrConfidences"]),
        F.lit(0.0),
    )


def students_of(results: DataFrame) -> DataFrame:
    """One row per student of a result payload; the last record of a number wins
    only in comparisons, so all are kept here with their position."""
    exam = first_known("examId")
    # the plain explode adds a filter on its list, for which Spark parses a payload twice more
    return results.select(
        exam.alias("exam_id"), "generatedAt", F.posexplode_outer("students").alias("student_pos", "s")
    ).where(F.col("student_pos").isNotNull()).select(
        "exam_id",
        "generatedAt",
        "student_pos",
        first_known(F.col("s.studentNumber")).alias("student_number"),
        F.col("s.studentNumberConfidence").alias("number_confidence"),
        safe_double(F.col("s.totalScore")).alias("total_score"),
        safe_double(F.col("s.totalMaxPoints")).alias("total_max_points"),
        F.col("s.error").alias("error"),
        F.col("s.questions").alias("questions"),
    )


def questions_of(students: DataFrame, question_schema: T.StructType) -> DataFrame:
    """One row per question; keeps the typed record and which optional fields it had."""
    rows = students.select(
        "exam_id", "student_number", "student_pos", F.explode("questions").alias("q_num", "raw")
    )
    # anything that is not an object is skipped, as is a null
    rows = rows.where(F.col("raw").startswith("{"))
    return rows.select(
        "exam_id",
        "student_number",
        "student_pos",
        "q_num",
        F.from_json("raw", question_schema).alias("q"),
        F.array_contains(F.json_object_keys("raw"), "isCorrect").alias("has_is_correct"),
    )


def question_results(questions: DataFrame) -> DataFrame:
    q = F.col("q")
    clean = strip_images(questions.select("exam_id", "student_number", "q_num", "has_is_correct", "q"))
    return clean.select(
        "exam_id",
        "student_number",
        "q_num",
        F.coalesce(q["type"], F.lit("unknown")).alias("q_type"),
        safe_double(q["score"]).alias("score"),
        safe_double(q["maxPoints"]).alias("max_points"),
        q["status"].alias("status"),
        question_confidence(q).alias("confidence"),
        review_in_store(q["needsReview"], q["status"]).alias("needs_review"),
        is_correct(q["status"]).alias("is_correct"),
        q["expected"].alias("expected_json"),
        F.to_json(q).alias("raw_result_json"),
        "has_is_correct",
        q["isCorrect"].alias("reader_is_correct"),
    )


def ocr_outputs(questions: DataFrame) -> DataFrame:
    """Read texts of every kind in one table: chosen options, cells, open text. They are listed in their question's row, in one pass over the payloads."""
    q = F.col("q")
    keys = ["exam_id", "student_number", "q_num"]
    base = questions.select(*keys, "q", question_confidence(q).alias("_conf"))
    kind = F.coalesce(q["type"], F.lit("unknown"))

    def output(kind: Column, text: Column, confidence: Column, **about: Column) -> Column:
        return record(output_type=kind, text=F.coalesce(text, F.lit("")), confidence=confidence, payload_json=F.to_json(record(**about)))

    chosen = F.when(
        kind.isin("multiple_choice", "multi_select"),
        F.array(output(kind, q["selected"], F.col("_conf"), selected=q["selected"], status=q["status"], is_correct=is_correct(q["status"]))),
    )
    cells = F.transform(
        F.map_entries(q["ocrAnswers"]),
        lambda c: output(
            F.concat(kind, F.lit(":"), c["key"]), c["value"], safe_double(F.try_element_at(q["ocrConfidences"], c["key"])),
            item=c["key"], source=F.try_element_at(q["ocrSources"], c["key"]),
        ),
    )
    open_text = F.when(
        kind == "open_ended",
        F.array(output(F.lit("open_ended_text"), q["studentReadText"], F.col("_conf"), expectedText=q["expectedText"], status=q["status"])),
    )
    empty = F.array().cast("array<struct<output_type:string,text:string,confidence:double,payload_json:string>>")
    found = F.flatten(F.array(*[F.coalesce(part, empty) for part in (chosen, cells, open_text)]))
    return base.select(*keys, F.explode(found).alias("_o")).select(*keys, "_o.*")


def llm_evaluations(questions: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    q = F.col("q")
    return questions.where(q["type"] == "open_ended").select(
        "exam_id",
        "student_number",
        "q_num",
        F.lit(cfg.grading_model).alias("model_name"),
        safe_double(q["score"]).alias("score"),
        q["explanation"].alias("explanation"),
        F.to_json(
            F.struct(
                q["status"].alias("status"),
                question_confidence(q).alias("confidence"),
                review_in_store(q["needsReview"], q["status"]).alias("needsReview"),
                q["studentReadText"].alias("studentReadText"),
                q["expectedText"].alias("expectedText"),
                q["explanation"].alias("explanation"),
            )
        ).alias("reasoning_json"),
    )


def exams_of(results: DataFrame) -> DataFrame:
    return results.select(
        first_known("examId").alias("exam_id"),
        F.coalesce("totalStudents", F.lit(0)).alias("total_students"),
        F.coalesce("totalQuestions", F.lit(0)).alias("total_questions"),
        F.coalesce("aiEnabled", F.lit(False)).alias("ai_enabled"),
        F.col("excelPath").alias("excel_path"),
        F.col("generatedAt").alias("generated_at"),
        F.col("pipelineError").alias("pipeline_error"),
    )


def exam_results_of(students: DataFrame, question_rows: DataFrame) -> DataFrame:
    review = question_rows.groupBy("exam_id", "student_number").agg(F.bool_or("needs_review").alias("_r"))
    return students.join(review, ["exam_id", "student_number"], "left").select(
        "exam_id",
        "student_number",
        "number_confidence",
        "total_score",
        "total_max_points",
        F.coalesce("_r", F.lit(False)).alias("needs_review"),
    )


def normalise(
    results: DataFrame, question_schema: T.StructType, cfg: Thresholds = DEFAULTS, hold: Callable[[DataFrame, str], DataFrame] = lambda df, name: df
) -> dict[str, DataFrame]:
    """All store tables of a payload, keyed by exam, student number and question. Every table reads the parsed payloads again; ``hold`` may
    write them (``session.keep``), so that they are parsed once."""
    results = hold(results, "payload-results")
    students = students_of(results)
    questions = hold(questions_of(students, question_schema), "payload-questions")
    rows = question_results(questions)
    return {
        "exams": exams_of(results),
        "exam_results": exam_results_of(students, rows),
        "question_results": rows,
        "ocr_outputs": ocr_outputs(questions),
        "llm_evaluations": llm_evaluations(questions, cfg),
    }
