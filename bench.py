"""Benchmark: run the headline queries once each and print one JSON line.

BENCH_SF_DIR  directory of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gradewright.plans.queries import REGISTRY  # noqa: E402
from gradewright.session import local_session, table  # noqa: E402

HEADLINE = (
    # cohort analytics
    "student_totals", "exam_summary", "class_summary", "hardest_questions", "accuracy_grouping_sets",
    "score_histogram", "score_median", "per_question_status", "papers_needing_review",
    # grading rules
    "mark_classify_single", "score_single", "score_multi", "score_cells", "fuzzy_match", "rubric_score",
    "verdict_postprocess", "safety_flags",
    # readers
    "letter_vote", "best_lines", "student_number", "restricted_argmax",
    # pages and logs
    "student_split", "batch_bracketing", "timing_by_type", "batch_totals",
    # store, changes, export
    "result_tree", "override_recompute", "approval_upsert", "audit_log", "uniqueness_check", "score_sheet_pivot",
    "archetype_answers", "request_dedupe", "islands",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    table(spark, sf_dir, "nation").count()  # the first job starts the executor, it is not measured
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
