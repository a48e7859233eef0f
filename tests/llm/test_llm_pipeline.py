import random

import brute
import pytest

import corpus_pipeline
from gradewright.llm import mixing
from llm_fixtures import frame, prose  # noqa: F401


@pytest.fixture(scope="module")
def folder(frame, prose, spark, tmp_path_factory):
    """Documents with junk, near copies, leaks and several sources."""
    r, rows = random.Random(8), []
    for i in range(240):
        words = prose(i, 60 + i % 80).split(" ")
        rows.append((i, " ".join(words), f"s{i % 4}"))
    for i in range(0, 60, 3):
        words = rows[i][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "s1"))
    leak = prose(5000, 20)
    rows += [(2000 + i, f"{prose(6000 + i, 60)} {leak} {prose(7000 + i, 60)}", "s2") for i in range(5)]
    rows += [(3000, None), (3001, "too short"), (3002, "same eight words again and again and more " * 9)]
    path = tmp_path_factory.mktemp("tables")
    frame(rows).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", rows, leak


def test_stages(spark, folder):
    sf_dir, rows, leak = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, columns, now = {r[0]: r[1] for r in rows}, docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        got = now.collect()
        seen[name] = got
        assert name == "shard" or now.columns == columns
        assert all(r.text == texts[r.doc_id] for r in got)
        now = spark.createDataFrame(got, now.schema)
    good = {r.doc_id for r in seen["quality"]}
    assert good == set(texts) - {3000, 3001, 3002}
    apart = {k for k, (_, c) in brute.components({k: texts[k] for k in good}).items() if k == c}
    assert {r.doc_id for r in seen["near_dedup"]} == apart and len(seen["near_dedup"]) == len(apart)
    clean = {k for k in apart if not brute.contamination({k: texts[k]}, [(1, leak)])[k][1]}
    assert {r.doc_id for r in seen["decontaminate"]} == clean and len(apart) - len(clean) == 5
    want = mixing.report(spark.createDataFrame(seen["decontaminate"], docs.schema)).collect()
    times = {r.doc_id: r.taken // r["size"] for r in want}
    got = {}
    for r in seen["mix"]:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: n for k, n in times.items() if n}
    assert sorted(r.doc_id for r in seen["shard"]) == sorted(r.doc_id for r in seen["mix"])
    for s in {r.shard for r in seen["shard"]}:
        slots = sorted(r.slot for r in seen["shard"] if r.shard == s)
        assert slots == list(range(len(slots)))
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.shard) for r in ran) == sorted((r.doc_id, r.shard) for r in seen["shard"])


def test_empty_documents(spark, tmp_path, frame):
    frame([]).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
