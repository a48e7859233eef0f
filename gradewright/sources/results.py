"""Result payloads and expectation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewright.schemas import EXPECTED, QUESTION_RESULT, RESULT


def read_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Payloads, one document per line, which splits files among tasks, or one per file with ``multi_line``."""
    return spark.read.schema(RESULT).option("multiLine", multi_line).json(path)


def results_from_text(payloads: DataFrame, column: str = "value") -> DataFrame:
    return payloads.select(F.from_json(column, RESULT).alias("r")).select("r.*")


def question_schema() -> T.StructType:
    return T.StructType.fromDDL(QUESTION_RESULT)


def read_expected(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Expected totals and answers: one row per student and question. One document per line, or per file with ``multi_line``."""
    doc = spark.read.schema(EXPECTED).option("multiLine", multi_line).json(path)
    students = doc.select("examId", F.explode("students").alias("s"))
    return students.select(
        F.col("examId").alias("exam_id"),
        F.col("s.studentNumber").alias("student_number"),
        F.col("s.edgeCase").alias("edge_case"),
        F.col("s.expectedTotalScore").alias("expected_total"),
        F.col("s.expectedMaxPoints").alias("expected_max"),
        F.explode_outer("s.expectedQuestions").alias("q_num", "expected"),
    )


def cells_of(questions: DataFrame) -> DataFrame:
    """Read cells with confidence and source, looked up by item."""
    q = F.col("q")
    return questions.select("exam_id", "student_number", "q_num", "q", F.explode(q["ocrAnswers"]).alias("item", "text")).select(
        "exam_id",
        "student_number",
        "q_num",
        "item",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.try_element_at(q["ocrConfidences"], F.col("item")), F.lit(0.0)).alias("confidence"),
        F.try_element_at(q["ocrSources"], F.col("item")).alias("source"),
    )
