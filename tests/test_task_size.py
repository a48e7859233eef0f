"""Rows of a task at size: how rows are dealt out."""

import pytest
from pyspark.sql import functions as F

from gradewright import session
from gradewright.plans import adapters, queries

SF = "/root/testdata/sf0.001"


def parts(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_few_rows_are_left_to_spark(spark):
    assert parts(session.dealt(spark.range(1000), ["id"], 1000)) <= 4
    assert session.dealt(spark.range(1000), ["id"], 20 * session.TASK_ROWS).rdd.getNumPartitions() == 20


@pytest.mark.parametrize("rows", [lambda s: adapters.question_results(s, SF), lambda s: queries._events(s, SF)[0]])
def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch, rows):
    before = sorted(rows(spark).collect(), key=str)
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    got = rows(spark)
    assert parts(got) > 30
    assert sorted(got.collect(), key=str) == before


def test_store_rules_hold_a_bounded_number_of_rows(spark, monkeypatch):
    from gradewright.operators import changes

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    keys = spark.range(6000).select(F.lit("E").alias("exam_id"), F.col("id").cast("string").alias("student_number"))
    twice = keys.unionByName(keys)
    got = changes.validate_store({"exam_results": twice}, 12000)
    assert got.count() == 6000 and parts(got) > 30
