"""A dedup job writes and moves keys, not its tables' rows and vectors."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.graph import KnowledgeGraph
from factloom.operators import dedup, entities, store
from factloom.schema import TRIPLE_KEY, TRIPLES

ROWS = "id string, subject string, predicate string, object string, type string, source string, source_root string, confidence double, extracted_at int"


def made(rng, n, repeat):
    rows = [(f"{i:04d}", f"s{i}", "p", None if i % 50 == 7 else "o", "TU"[i % 2], f"g{i % 3}_chunk_{i % 2}", f"g{i % 3}", float(rng.integers(0, 100)), int(rng.integers(0, 1000))) for i in range(n)]
    if repeat:  # with another id, source, confidence and time
        rows += [(f"{i:04d}b", *rows[i][1:5], "g1_chunk_0", "g1", 200.0 + i, i) for i in range(0, n, 9)]
        rows += [(rows[3][0], "s3 p", "o", "", "T", *rows[3][5:])]  # one id, and one text but for a blank
    return rows


@pytest.mark.parametrize("repeat", [False, True])
@pytest.mark.parametrize("threshold", [0.3, 0.95, 1.0])
def test_merged_keys_are_those_of_the_whole_rows(spark, tmp_path, monkeypatch, threshold, repeat):
    """Against dedup of whole rows: copies of vectors and of keys, zero vectors, nulls."""
    rng = np.random.default_rng(3)
    base = [*np.eye(6)[:4], *rng.normal(size=(12, 6)), np.zeros(6)]
    triples = spark.createDataFrame(made(rng, 200, repeat), ROWS)
    texts = sorted({r["text"] for r in triples.select(F.concat_ws(" ", "subject", "predicate", "object").alias("text")).collect()})
    told = spark.createDataFrame([(t, [float(x) for x in base[rng.integers(0, len(base))]]) for t in texts], "text string, embedding array<float>")
    key = lambda df: sorted(map(repr, df.select(*dedup.KEY_BITS, "confidence", "extracted_at", F.col("n_merged") > 1).collect()))
    want = dedup.deduplicated(triples, told, threshold).withColumns(dict(zip(dedup.KEY_BITS, dedup.key_bits())))
    if not repeat:
        monkeypatch.setattr(dedup, "exact_dedup", None)  # keys that don't repeat are not moved to be merged
    sizes = []

    def stage(df):
        path = f"file://{tmp_path}/{len(sizes)}"
        df.write.parquet(path)
        sizes.append((df.columns, spark.read.parquet(path).count()))
        return spark.read.schema(df.schema).parquet(path)

    exact, got = dedup.merged_keys(triples, told, threshold, stage=stage)
    assert key(got) == key(want)
    assert exact.count() == triples.select(*TRIPLE_KEY).distinct().count()
    vectors = [n for c, n in sizes if "embedding" in c]
    assert len(vectors) == 1 and (vectors[0] == exact.count() if threshold == 1 else vectors[0] < exact.count())


def test_vectors_of_unequal_lengths_leave_exact_dedup(spark):
    triples = spark.createDataFrame(made(np.random.default_rng(1), 20, True), ROWS)
    told = triples.select(F.concat_ws(" ", "subject", "predicate", "object").alias("text")).distinct().withColumn("embedding", F.when(F.col("text") < "s2", F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))))
    exact, got = dedup.merged_keys(triples, told, 0.5, stage=lambda df: df.checkpoint())
    assert got.count() == exact.count() == triples.select(*TRIPLE_KEY).distinct().count() < triples.count()


def test_a_job_that_merges_nearly_all_leaves_no_keys_to_join(spark, tmp_path, monkeypatch):
    """Embeddings are written once; the triples left are written in place of the keys of those gone."""
    monkeypatch.setattr(store.Store, "REWRITTEN", 50)
    g = KnowledgeGraph(spark, f"file://{tmp_path}/g", embedder=lambda t: np.eye(64)[[len(x) % 3 for x in t]], semantic_dedup=0.9)
    rows = [(f"{i:03d}", f"s{'x' * (i % 9)}{i:03d}", "p", "o", "ENTITY_ENTITY", f"a{i % 2}_chunk_{i % 5}", "file", None, None, None) for i in range(200)]
    g.publish_rows("triples", spark.createDataFrame(rows, TRIPLES).withColumn("confidence", F.expr("cast(id as int) % 100 / 100")))
    g.publish_rows("triples", spark.createDataFrame([("z", "other", "p", "o", "ENTITY_ENTITY", "b", "file", None, None, None)], TRIPLES))
    said = g.dedup_job(spark.createDataFrame([("a0", "file"), ("a1", "file"), ("none", "file")], "source string, source_type string"), "2025-01-01 00:00:00")
    assert sorted(map(tuple, said.collect())) == [("a0", "file", 100, 3, 97, False), ("a1", "file", 100, 3, 97, False), ("none", "file", 0, 0, 0, False)]
    left = {(r["source"][:2], len(r["subject"]) % 3): (r["id"], float(r["confidence"])) for r in g.table("triples").filter("id <> 'z'").collect()}
    want = {}
    for r in rows:
        want.setdefault((r[5][:2], len(r[1]) % 3), []).append(r[0])
    assert left == {k: (min(of), max(int(i) % 100 for i in of) / 100) for k, of in want.items()} and g.table("triples").count() == 7
    named = g.store.manifest()[1]
    assert named["triples"]["deletes"] == [] and len(named["triples"]["data"]) == 2
    assert g.table("dictionary").count() == 200 and not [p for p in Path(tmp_path, "g/staging").glob("*/*.parquet") if "embedding" in spark.read.parquet(str(p)).columns and spark.read.parquet(str(p)).count() > 6]
    assert g.enumerate_entities().agg(F.sum("occurrences")).first()[0] == 14


def test_rows_left_by_a_large_delete_keep_their_numbers(spark, tmp_path, monkeypatch):
    """Publishers that worked from an earlier manifest: rows that came later stay, keys are stored once, views and filters follow."""
    monkeypatch.setattr(store.Store, "REWRITTEN", 2)
    schema = {"t": "k string, v int"}
    rows = lambda *made: spark.createDataFrame(list(made), schema["t"])
    s = store.Store(spark, f"file://{tmp_path}/s", {"t": ["k"]}, {"t": {"by_v": lambda df: df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))}})
    s.publish({"t": rows(*[(f"k{i}", i % 2) for i in range(6)], (None, 5))}, None, schema)
    first = s.manifest()[0]
    s.publish({"t": rows(("late", 7), ("late2", 8))}, None, schema)
    s.publish({}, None, schema, deleted={"t": rows(*[(f"k{i}", 0) for i in range(5)], (None, 0), ("late", 0)).select("k")}, as_of=first)
    held = lambda: sorted((r["k"] or "", r["v"]) for r in s.read("t", schema["t"]).collect())
    assert held() == [("k5", 1), ("late", 7), ("late2", 8)] and s.manifest()[1]["t"]["deletes"] == []
    assert sorted(map(tuple, s.view("t", "by_v", schema["t"]).collect())) == [(1, 1), (7, 1), (8, 1)]
    s.publish({}, None, schema, deleted={"t": rows(("late", 0), ("k5", 0)).select("k")}, as_of=first)  # late came after
    assert held() == [("late", 7), ("late2", 8)]
    s.publish({"t": rows(("late2", 1), ("k5", 2))}, None, schema, keys={"t": ["k"]}, as_of=first)
    assert held() == [("k5", 2), ("late", 7), ("late2", 8)]
    assert [r["k"] for r in s.new_rows("t", rows(("late", 0), ("k0", 3)), schema["t"]).collect()] == ["k0"]


def test_counts_are_written_in_order_and_lost_rows_met_once(spark, tmp_path, monkeypatch):
    """Counts of entities stand sorted in each file; a delete's rows are joined once, however many views count them."""
    from factloom.graph import VIEWS

    s = store.Store(spark, f"file://{tmp_path}/s", {"triples": TRIPLE_KEY}, VIEWS)
    rows = [(f"{i}", f"s{i * 37 % 50}", "p", f"o{i}", "ENTITY_ENTITY", f"a{i % 7}", "file", None, None, None) for i in range(300)]
    triples = spark.createDataFrame(rows, TRIPLES).repartition(3, "id")
    s.publish({"triples": triples}, None, {"triples": TRIPLES})
    met, lost = [], s._lost
    monkeypatch.setattr(s, "_lost", lambda *a: met.append(1) or lost(*a))
    s.publish({}, None, {"triples": TRIPLES}, deleted={"triples": triples.filter("id < 5").select(*TRIPLE_KEY)})
    assert len(met) == 1 and len(VIEWS["triples"]) == 2
    kept = {c for p in Path(tmp_path, "s/triples-lost").glob("*/*.parquet") for c in spark.read.parquet(str(p)).columns}
    assert kept == {"subject", "object", "type", "source", "extracted_at", "confidence"}  # ids and dates are not moved
    files = [str(p) for f in s.manifest()[1]["triples"]["views"]["entities"] for p in Path(f[5:]).glob("*.parquet")]
    for f in files:
        said = [(r["entity"], r["source"]) for r in spark.read.parquet(f).coalesce(1).collect()]
        assert said == sorted(said)
    assert len(files) > 3
    left = s.read("triples", TRIPLES)
    want = sorted(map(tuple, entities.enumerate_entities(left).collect()))
    assert sorted(map(tuple, entities.enumerate_counted(s.view("triples", "entities", TRIPLES, by=entities.COUNTED_BY)).collect())) == want
    assert sorted(map(tuple, s.view("triples", "kinds", TRIPLES).collect())) == sorted(map(tuple, entities.kind_counts(left).collect()))
