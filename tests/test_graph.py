import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.graph import KnowledgeGraph
from factloom.operators import jobs
from factloom.operators.extract import rule_extractor
from factloom.operators.model import Extracted
from factloom.streaming import job_stream
from factloom.streaming.job_state import Rules

TEXTS = [
    ("d1", "Alice Moor works at Tech Corp. Tech Corp is based in San Francisco.", "notes", "file"),
    ("d2", "Alice Moor works at Tech Corp. Bob Hill lives in Lisbon.", "mail", "file"),
    ("d3", None, "mail", "file"),
    ("d4", "", "mail", "file"),
]
DOCS = "id string, text string, source string, source_type string"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    g = KnowledgeGraph(spark, f"file://{tmp_path_factory.mktemp('graph')}")
    g.process_knowledge(spark.createDataFrame(TEXTS, DOCS), "2025-01-01 00:00:00")
    return g


def test_repeated_facts_are_stored_once(spark, graph):
    rows = {(r["subject"], r["predicate"], r["object"]) for r in graph.table("triples").collect()}
    assert rows == {("Alice Moor", "works at", "Tech Corp"), ("Tech Corp", "is based in", "San Francisco"), ("Bob Hill", "lives in", "Lisbon")}
    before = {n: graph.table(n).count() for n in ("triples", "concepts", "conceptualizations", "vectors")}
    jobs_before = graph.table("jobs").count()
    again = graph.process_knowledge(spark.createDataFrame(TEXTS, DOCS), "2025-01-02 00:00:00")
    assert {n: graph.table(n).count() for n in before} == before and before["triples"] == 3
    assert graph.table("jobs").count() == 2 * jobs_before
    said = [json.loads(r["result"]) for r in again.filter("stage = 'CONCEPTS'").collect()]
    assert all(s["skipped"] for s in said)  # the sources have concepts


def test_concepts_carry_their_source(graph):
    concepts = {(r["concept"], r["source"], r["source_type"]) for r in graph.table("concepts").collect()}
    assert ("corp", "notes", "file") in concepts and ("lisbon", "mail", "file") in concepts
    ids = [r["id"] for r in graph.table("concepts").collect()]
    assert len(ids) == len(set(ids)) == len(concepts)
    links = graph.table("conceptualizations").collect()
    assert all(r["source"] in ("notes", "mail") and 1 <= len(r["context_triples"]) <= 5 for r in links)
    assert graph.table("vectors").filter("vector_type = 'CONCEPT'").count() == len(concepts)


def test_search(graph):
    (first, *_) = graph.search_knowledge_graph("works at", threshold=0.0).collect()
    assert (first["subject"], first["predicate"]) == ("Alice Moor", "works at")
    only = graph.search_knowledge_graph("Alice Moor works at Tech Corp", legs=("semantic",)).collect()
    assert [(r["subject"], r["n_legs"]) for r in only] == [("Alice Moor", 1)]
    assert graph.search_knowledge_graph("nothing like it", threshold=1.0).collect() == []
    for bad in ({"limit": 0}, {"threshold": 2}, {"weights": {"entity": 3}}, {"legs": ("other",)}):
        with pytest.raises(ValueError):
            graph.search_knowledge_graph("x", **bad)


def test_search_variants(graph):
    hits, months = graph.search_by_text("Alice Moor works at Tech Corp", threshold=0.5)
    assert {r["subject"] for r in hits.collect()} == {"Alice Moor", "Tech Corp"} and months.collect() == []  # no source date is known
    vector = graph.embedder(["Alice Moor works at Tech Corp"])[0].tolist()
    near, concepts, _ = graph.search_by_embedding(vector)
    assert near.first()["subject"] == "Alice Moor" and near.first()["score"] == pytest.approx(1, abs=1e-6) and concepts.collect() == []
    near, concepts, _ = graph.search_by_embedding(graph.embedder(["corp"])[0].tolist())
    assert near.collect() == [] and concepts.first()["concept"] == "corp"


def test_status_concepts_and_stats(graph):
    (s,) = graph.get_pipeline_status("job-d1").collect()
    assert set(s["stages"]) == {"EXTRACTION", "CONCEPTS"} and s["status"] == "COMPLETED"  # dedup is switched off
    assert s["stages"]["EXTRACTION"]["status"] == "COMPLETED" and json.loads(s["stages"]["EXTRACTION"]["metrics"])["total_chunks"] == 1
    assert graph.get_pipeline_status("job-none").collect() == []
    assert {r["concept"] for r in graph.search_concepts("CORP").collect()} == {"corp"}
    (t,) = graph.get_knowledge_graph_stats().collect()
    assert t["total_triples"] == 3 and t["triples_by_type"]["ENTITY_ENTITY"] == 3 and t["triples_by_type"]["EVENT_EVENT"] == 0


def test_store_counts(spark, tmp_path):
    g = KnowledgeGraph(spark, f"file://{tmp_path}/g")
    raw = [("a", "p", "b", "X", "s", "file", 0.5), ("a", "p", "b", "X", "s", "file", 0.9), ("c", "p", "c", "X", "s", "file", None), ("\x00d ", "p", "e", "X", "s", "file", 7.0)]
    table = spark.createDataFrame(raw, "subject string, predicate string, object string, type string, source string, source_type string, confidence double").withColumn("extracted_at", F.lit("2025-01-01").cast("timestamp"))
    assert g.store_triples(table).first().asDict() == {"triples_stored": 3, "duplicates_skipped": 1, "vectors_generated": 4 + 3 + 4}
    assert g.store_triples(table).first()["duplicates_skipped"] == 4
    assert {(r["subject"], float(r["confidence"])) for r in g.table("triples").collect()} == {("a", 0.9), ("c", 0.0), ("d", 1.0)}
    concepts = spark.createDataFrame([("Corp", "high", 2.0, "s", "file"), ("Corp", "HIGH", 0.1, "s", "file")], "concept string, abstraction_level string, confidence double, source string, source_type string")
    assert g.store_concepts(concepts).first().asDict() == {"concepts_stored": 1, "duplicates_skipped": 1, "vectors_generated": 1}
    short = KnowledgeGraph(spark, f"file://{tmp_path}/other", dimension=10)
    with pytest.raises(ValueError, match="VECTOR_DIMENSION_ERROR"):
        short.store_triples(table)
    assert short.table("triples").count() == 0  # nothing of a rejected batch is seen


def usage_extractor(text, kinds):
    """Fails for a text that says so, and tells what it used."""
    if "broken" in text:
        raise RuntimeError("no answer")
    out = rule_extractor(text, kinds)
    return Extracted(out.triples, [], [{"input_tokens": 1000, "output_tokens": 500, "total_tokens": 1500, "operation_type": "extraction", "provider": "x", "model": "x/m", "duration_ms": 3}])


def test_states_usage_and_dedup_job(spark, tmp_path):
    prices = spark.createDataFrame([("m", 1.0, 2.0, 0.0, 0.0)], "price_model string, price_in double, price_out double, price_thinking double, price_reasoning double")
    g = KnowledgeGraph(spark, f"file://{tmp_path}/g", extractor=usage_extractor, embedder=lambda t: np.ones((len(t), 64)), semantic_dedup=0.9, prices=prices)
    docs = [("1", "Ann Lee likes Rome. Ann Lee loves Rome. Bob Ray likes Oslo.", "s1", "file"), ("2", "broken", "s2", "file"), ("3", "Cy Dee likes Bonn.", "s10", "file")]
    g.process_knowledge(spark.createDataFrame(docs, DOCS), "2025-01-01 00:00:00")
    states = {r["id"]: r for r in g.table("jobs").collect()}
    assert states["job-1"]["status"] == "COMPLETED" and states["job-2"]["status"] == "FAILED"
    assert states["job-2-extraction"]["error_message"] == "no answer" and json.loads(states["job-2-extraction"]["result"])["failed_chunks"] == 1
    # all vectors are alike: of each source one triple stays, and s1 is not s10
    assert json.loads(states["job-1-deduplication"]["result"]) == {"original": 3, "remaining": 1, "removed": 2, "skipped": False}
    assert {r["source"] for r in g.table("triples").collect()} == {"s1_chunk_0", "s10_chunk_0"}
    left = {r["id"] for r in g.table("triples").collect()}
    assert {r["knowledge_triple_id"] for r in g.table("vectors").filter("vector_type <> 'CONCEPT'").collect()} == left
    (used, _) = g.table("token_usage").orderBy("source").collect()
    assert float(used["estimated_cost"]) == 2.0 and used["total_tokens"] == 1500


def test_jobs_as_a_stream(spark, tmp_path):
    """The graph's own handlers, from a request to the end; a repeated event and a repeated batch count once."""
    prices = spark.createDataFrame([("m", 1.0, 2.0, 0.0, 0.0)], "price_model string, price_in double, price_out double, price_thinking double, price_reasoning double")
    g = KnowledgeGraph(spark, f"file://{tmp_path}/g", extractor=usage_extractor, prices=prices)
    docs = spark.createDataFrame([("1", "Ann Lee likes Rome.", "s", "file")], DOCS)
    events = jobs.pipeline_events(docs, "2025-01-01 00:00:00", with_dedup=True).withColumns({"event_time": F.lit("2025-01-01").cast("timestamp"), "retry_count": F.lit(0), "max_retries": F.lit(3)})
    where, out = f"{tmp_path}/events", f"{tmp_path}/done"
    asked = events.filter("stage is null or stage = 'EXTRACTION'")
    job_stream.enqueue(spark, where, asked)
    job_stream.enqueue(spark, where, asked)
    handlers = job_stream.graph_handlers(g, "2025-01-01 00:00:00")
    query = job_stream.run_jobs(spark, where, out, f"{tmp_path}/state", handlers, Rules(second=1), every="200 milliseconds")
    job_stream.wait_until_final(query, spark, out, 4, 300)
    done = {r["id"]: r for r in job_stream.job_states(spark, out).collect()}
    assert {k: r["status"] for k, r in done.items()} == {f"job-1{s}": "COMPLETED" for s in ("", "-extraction", "-concepts", "-deduplication")}
    assert json.loads(done["job-1-extraction"]["result"])["triples"] == 1 and g.table("triples").count() == 1 and g.table("concepts").count() > 0
    run = events.filter("stage = 'EXTRACTION'")
    before = [r["id"] for r in g.table("token_usage").collect()]
    handlers["EXTRACT_KNOWLEDGE_BATCH"](run)  # as a repeated batch does
    assert [r["id"] for r in g.table("token_usage").collect()] == before and len(before) == 1
    handlers["EXTRACT_KNOWLEDGE_BATCH"](run.withColumn("retry_count", F.lit(1)))  # another attempt asks again
    assert g.table("token_usage").count() == 2
    waits = {r["stage"]: r["not_before"] for r in events.filter("stage is not null").collect()}
    assert (waits["CONCEPTS"] - waits["EXTRACTION"]).seconds == 6 and (waits["DEDUPLICATION"] - waits["EXTRACTION"]).seconds == 10
    assert waits["EXTRACTION"] == datetime(2025, 1, 1)
