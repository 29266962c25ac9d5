"""The registry, and a sample of its queries against their SQL twins at the smallest scale.

``tools/check.py`` compares all of them; here a few of each kind keep the suite short.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "retrieval_ranked", "evidence_blocks", "blend_features", "blend_allocation", "component_page", "session_titles",
    "message_context", "agent_plans", "graph_counts", "concept_connections", "paper_sections", "paper_chunks",
    "ingest_outcomes", "cleaned_transcripts", "stable_partials", "speech_segments_sensitive", "stream_changes",
)


def test_every_oracle_has_a_query_and_names_are_plain():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert all(name.isidentifier() for name in queries)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_twin(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = entry_module.queries()[name](spark, FOLDER)
    want = db.sql(entry_module.oracle_sql()[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(want.columns, want.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_plans_push_filters_and_avoid_cartesian_joins(spark):
    df = entry_module.queries()["retrieval_filtered"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan or "EqualTo(label,3)" in plan
    for name in ("concept_connections", "concept_fan_in", "blend_features", "knowledge_requests", "barge_ins"):
        text = entry_module.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_stored_ingest_equals_the_plans(spark):
    from emberline.plans import ingest as ing

    schema = "paper_id long, raw_path string, pages array<string>, source string, lang string"
    rows = [
        (1, "C:\\Coal blend paper\\CSR\\a.pdf", ["Abstract\n" + "x " * 80, "Results\nfine"], "s", "en"),
        (2, "C:\\b.pdf", ["too short"], "s", "en"),
        (3, "C:\\c.pdf", ["y" * 200], "s", "en"),
    ]
    papers = spark.createDataFrame(rows, schema)
    seen = spark.createDataFrame([("C:/c.pdf",)], "file_path string")
    plain, stored = ing.ingest(papers, seen), ing.ingest(papers, seen, store=True)
    assert sorted(map(tuple, plain.outcomes.collect())) == [(1, "success", 2), (2, "failed", 1), (3, "skipped", 0)]
    for a, b in zip(plain, stored):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert [(r["file_path"], r["category"], r["chunk_count"]) for r in stored.catalog.collect()] == [("C:/Coal blend paper/CSR/a.pdf", "CSR", 2)]
    audit = spark.createDataFrame([("success", 2.0), ("failed", 4.0)], "status string, seconds double")
    assert tuple(ing.progress(audit, 5).first()) == (2, 3.0, 9.0)
