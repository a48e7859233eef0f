"""The store: Parquet tables partitioned by exam and run, and the report files.

A delivery writes only the partitions of its own exams, under a new run id, and
then appends one pointer row per exam. Readers follow the newest pointer of each
exam, which also prunes the partitions they open. A failed delivery leaves no
pointer, so the old state stays readable; a repeated one just adds a newer run.
Superseded runs stay readable for those who began before, until they are expired.

Rows are gathered by exam before they are written, small exams together and a large
exam in several files, so that a run has files by size and not by task. Students get their
numbers last, after the pointers: from blocks of ids, each claimed by creating a file that must not exist.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewright.operators.running import surrogate_ids
from gradewright.session import dealt

TABLES = (
    "exams",
    "exam_results",
    "question_results",
    "ocr_outputs",
    "llm_evaluations",
    "teacher_overrides",
    "final_approvals",
    "audit_logs",
)
BLOCK = 100_000  # ids claimed at a time
STUDENTS = "student_id bigint, student_number string"


class ResultStore:
    """Tables under one root: ``<table>/_exam=<id>/_run=<id>``, ``students``, ``_pointers`` and ``_ids``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _load(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _live(self) -> DataFrame | None:
        pointers = self._load("_pointers")
        if pointers is None:
            return None
        return pointers.groupBy("_exam").agg(F.max_by("_run", F.struct("at", "_run")).alias("_run"))

    def read(self, table: str) -> DataFrame | None:
        """Current rows of a table; None when nothing was ever stored."""
        if table == "students":
            rows = self._load("students")
            # two deliveries may have met a student at the same time; the lower id is the one that counts
            return None if rows is None else dealt(rows, ["student_number"], rows.count()).groupBy("student_number").agg(F.min("student_id").alias("student_id")).select("student_id", "student_number")
        rows, live = self._load(table), self._live()
        if rows is None or live is None:
            return None
        return rows.join(live, ["_exam", "_run"], "left_semi").drop("_exam", "_run")

    def replace_exams(self, tables: dict[str, DataFrame]) -> str:
        """Store a delivery and return its run id. All children of a delivered exam
        are replaced, also those the delivery has none of; students stay."""
        run = f"r{time.time_ns()}_{uuid.uuid4().hex}"
        # the prefix keeps ids that look like numbers as text
        exam = F.concat(F.lit("e_"), F.col("exam_id"))
        for name in TABLES:
            if name in tables:
                tagged = tables[name].withColumns({"_exam": exam, "_run": F.lit(run)})
                gathered = self.spark.sql("SELECT /*+ REBALANCE(_exam) */ * FROM {tagged}", tagged=tagged)
                gathered.write.mode("append").partitionBy("_exam", "_run").parquet(f"{self.root}/{name}")
        pointers = tables["exams"].select(exam.alias("_exam"), F.lit(run).alias("_run"), F.lit(time.time_ns()).alias("at"))
        pointers.coalesce(1).write.mode("append").parquet(f"{self.root}/_pointers")
        self.register_students()
        return run

    def register_students(self) -> int:
        """Give an id to every student of a current exam result who has none; how many there were. A delivery that failed
        after its pointers is made good by the next one."""
        results, students = self.read("exam_results"), self.read("students")
        if results is None:
            return 0
        numbers = dealt(results.select("student_number").where("student_number IS NOT NULL"), ["student_number"], results.count()).distinct()
        unseen = numbers if students is None else numbers.join(students, "student_number", "left_anti")
        n = unseen.count()
        if n:
            blocks = [self._claim() for _ in range(-(-n // BLOCK))]
            at = F.col("_n") - 1
            first = F.element_at(F.array(*[F.lit(b * BLOCK) for b in blocks]), (at / BLOCK).cast("int") + 1)
            created = surrogate_ids(unseen, "student_number", "_n", rows=n).select((first + at % BLOCK + 1).cast("bigint").alias("student_id"), "student_number")
            created.write.mode("append").parquet(f"{self.root}/students")
        return n

    def _files(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _claim(self) -> int:
        """The number of a block of ids that nobody else has: its file is created, and must not exist."""
        folder, fs = self._files(f"{self.root}/_ids")
        fs.mkdirs(folder)
        block = len(fs.listStatus(folder))
        while True:
            try:
                fs.create(self._files(f"{self.root}/_ids/block{block}")[0], False).close()
                return block
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                block += 1

    def superseded(self, table: str, older_than_s: float) -> Iterator[tuple[str, str]]:
        """(exam, run) partitions of a table that no reader needs: begun so long ago, and not the exam's current run."""
        rows, live = self._load(table), self._live()
        if rows is None:
            return
        begun = F.regexp_extract("_run", r"^r(\d+)_", 1).try_cast("bigint")
        old = rows.select("_exam", "_run").distinct().where(begun < time.time_ns() - int(older_than_s * 1e9))
        for row in (old if live is None else old.join(live, ["_exam", "_run"], "left_anti")).toLocalIterator():
            yield row["_exam"], row["_run"]

    def expire(self, older_than_s: float) -> int:
        """Delete superseded and failed runs that began so long ago; how many partitions there were."""
        n = 0
        for table in TABLES:
            for exam, run in self.superseded(table, older_than_s):
                escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(exam)
                path, fs = self._files(f"{self.root}/{table}/_exam={escaped}/_run={run}")
                n += bool(fs.delete(path, True))
        return n


def write_partitions(df: DataFrame, path: str, key: str = "exam_id") -> None:
    """Overwrite only the exams present in ``df`` (dynamic partition overwrite)."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def write_result_json(tree: DataFrame, path: str) -> None:
    """Per-exam result files: the student rows of an exam, one JSON line each."""
    tree.write.mode("overwrite").partitionBy("exam_id").json(path)


def write_sheet_csv(sheet: DataFrame, path: str, by_exam: bool = False) -> None:
    """Comma-separated grade book: quotes doubled, header, CRLF not needed."""
    writer = sheet.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    (writer.partitionBy("exam_id") if by_exam else writer).csv(path)


def read_sheet_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Without ``multi_line`` a file is split among tasks; with it fields may hold line ends, and a file is one task's."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)


def summary_json(overall: DataFrame, per_exam: DataFrame, per_type: DataFrame, rate_prefix: str = "") -> DataFrame:
    """Report rows (section, body): one overall, one per exam, one per type."""

    def section(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("body"))

    return section(overall, "overall").unionByName(section(per_exam, "exam")).unionByName(section(per_type, "type"))
