import re

import __spark_entry__ as entry
from gradewright.llm import oracle, queries

WITHOUT_SQL = {"op2_mix_sources", "op3_toxicity", "op8_quality_rules", "op9_secret_scan", "pipeline"}


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n not in entry.registered.REGISTRY]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert set(queries.REGISTRY) - set(oracle.SQL) == WITHOUT_SQL - {"pipeline"}
    assert set(entry.queries()) - set(entry.oracle_sql()) <= WITHOUT_SQL
