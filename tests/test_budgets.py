"""Embeddings that outlive their batch, and limits that a whole job keeps."""

import time
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.graph import KnowledgeGraph
from factloom.operators import extract, model
from factloom.operators.extract import hash_embedder
from factloom.schema import TRIPLE_TYPES

DOCS = "id string, text string, source string, source_type string"


def noted_embedder(folder):
    """Writes down what it is asked for."""

    def embed(texts):
        if texts:
            Path(folder, uuid.uuid4().hex).write_text("\n".join(texts))
        return hash_embedder(texts)

    return embed


def test_each_text_is_embedded_once_over_batches(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    asked = lambda: sorted(x for p in (tmp_path / "asked").iterdir() for x in p.read_text().split("\n"))
    make = lambda name: KnowledgeGraph(spark, f"file://{tmp_path}/g", embedder=noted_embedder(tmp_path / "asked"), semantic_dedup=0.9, model=name)
    texts = ["Ann Lee likes Rome. Bob Ray likes Oslo.", "Ann Lee likes Oslo.", "Ann Lee likes Rome. Cy Dee likes Rome."]
    for n, text in enumerate(texts):
        make("m").process_knowledge(spark.createDataFrame([(str(n), text, f"s{n}", "file")], DOCS), f"2025-01-0{n + 1} 00:00:00")
    first = asked()
    assert len(first) == len(set(first)) and {"Ann Lee", "likes", "Rome", "Ann Lee likes Rome", "Cy Dee likes Rome", "oslo"} <= set(first)
    triples = make("m").table("triples").count()
    assert make("m").table("vectors").filter("vector_type = 'SEMANTIC'").count() == triples == 4
    other = make("another")
    other._dictionary(spark.createDataFrame([("Rome",), ("Rome",), (None,)], "text string")).collect()
    assert asked().count("Rome") == 2 and other.table("dictionary").filter("text = 'Rome'").count() == 2


def test_vectors_of_a_wrong_length_are_not_kept(spark, tmp_path):
    g = KnowledgeGraph(spark, f"file://{tmp_path}/g", embedder=lambda t: np.ones((len(t), 3)), dimension=64)
    with pytest.raises(ValueError, match="VECTOR_DIMENSION_ERROR"):
        g._dictionary(spark.createDataFrame([("a",)], "text string"))
    assert g.table("dictionary").count() == 0


def test_a_jobs_limits_hold_over_its_workers(spark, tmp_path):
    """Four workers and one clock: together they make no more calls than the job may, in any span of time and at any moment."""
    capacity, rate, calls = 4.0, 8.0, 4
    (tmp_path / "calls").mkdir()
    folder = str(tmp_path / "calls")

    def client(prompt):
        began = time.time()
        time.sleep(0.02)
        Path(folder, uuid.uuid4().hex).write_text(f"{began} {time.time()}")
        return '{"triples": []}', {}

    extractor = model.ModelExtractor(client, "single-pass", limits={"calls": calls, "capacity": capacity, "rate": rate, "workers": 4})
    docs = spark.createDataFrame([(str(i), f"text {i}", "s", "file") for i in range(32)], DOCS).repartition(8)
    rows = extract.extraction_rows(docs, TRIPLE_TYPES, extractor)
    assert rows.rdd.getNumPartitions() == 4
    assert rows.filter("row = 'chunk'").count() == 32
    spans = sorted(tuple(map(float, p.read_text().split())) for p in Path(folder).iterdir())
    assert len(spans) == 32
    begun = [a for a, _ in spans]
    for i in range(32):
        for j in range(i, 32):
            assert j - i + 1 <= capacity + rate * (begun[j] - begun[i]) + 4 + 1e-6  # each share may be one call ahead
    assert max(sum(a <= t < b for a, b in spans) for t in begun) <= calls


def test_shares():
    share = model.share_of({"calls": 9, "capacity": 10.0, "rate": 2.0, "memory_mb": 5}, 4)
    assert share["calls"] == 2 and share["bucket"].capacity == 2.5 and share["bucket"].rate == 0.5 and share["memory_mb"] == 5
    with pytest.raises(ValueError):
        model.share_of({"calls": 2}, 4)
    assert model.ModelExtractor(lambda p: ("", {}), limits={"calls": 2}).workers == 2 and model.ModelExtractor(lambda p: ("", {})).workers is None
