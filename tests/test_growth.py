"""What queries move as tables grow: copies, hits and counts instead of whole rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import chunking
from factloom.operators import concepts, dedup, entities, filters, metric_join, search, store, vector_index

TRIPLES = "id string, subject string, predicate string, object string, type string, source_root string, confidence double, extracted_at int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """Nothing is sent because of its size alone."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("threshold", [0.3, 0.95, 1.0])
def test_copies_of_a_vector_go_through_the_pass_once(spark, monkeypatch, threshold):
    """Against a loop over all rows: copies, zero vectors, vectors with a gap, and rows without any."""
    rng = np.random.default_rng(1)
    base = [*np.eye(6)[:4], *rng.normal(size=(20, 6)), np.zeros(6)]
    at = rng.integers(0, len(base), 300)
    rows = [(f"{i:04d}", f"s{i}", "p", "o", "T", f"g{i % 3}", float(rng.integers(0, 100)), int(rng.integers(0, 1000))) for i in range(300)]
    told = [(f"s{i} p o", [float(x) for x in base[k]]) for i, k in enumerate(at) if i % 10]
    seen, whole = [], dedup.leaders
    monkeypatch.setattr(dedup, "leaders", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    got = dedup.semantic_dedup(spark.createDataFrame(rows, TRIPLES), spark.createDataFrame(told, "text string, embedding array<double>"), threshold).collect()
    want = {}
    for g in range(3):
        mine = [i for i in range(300) if i % 3 == g and i % 10]
        for i, lead in zip(mine, dedup.greedy_leaders(np.stack([base[at[i]] for i in mine]), threshold)):
            want.setdefault(mine[lead], []).append(i)
    want |= {i: [i] for i in range(0, 300, 10)}
    assert {(r["id"], r["confidence"], r["extracted_at"], r["n_merged"]) for r in got} == {
        (rows[k][0], max(rows[i][6] for i in of), max(rows[i][7] for i in of), len(of)) for k, of in want.items()
    }
    zeros = sum(1 for i, k in enumerate(at) if i % 10 and k == len(base) - 1)
    assert len(got) == len(want) and seen[0] == (270 if threshold == 1 else zeros + len({(i % 3, k) for i, k in enumerate(at) if i % 10 and k < len(base) - 1}))


def test_a_vector_search_moves_the_hits_rows(shuffled):
    """Ids that repeat, with other columns and without; vectors of nothing."""
    spark = shuffled
    items = spark.createDataFrame([(f"t{i % 40:02d}", f"n{i % 60}") for i in range(160)] + [(None, "x")], "id string, name string")
    vectors = spark.createDataFrame([("SEMANTIC", f"t{i % 50:02d}", [float(i % 7), 1.0]) for i in range(200)] + [("ENTITY", "t01", [0.0, 1.0]), ("SEMANTIC", None, [0.0, 1.0])],
                                    "vector_type string, knowledge_triple_id string, embedding array<double>")
    got = search.search_semantic(items, vectors, [0.0, 1.0], -3.5, 17)
    every = {(r["knowledge_triple_id"], 1 - r["embedding"][0]) for r in vectors.collect() if r["vector_type"] == "SEMANTIC" and r["knowledge_triple_id"] and r["embedding"][0] <= 4}
    rows = {(i["id"], i["name"], s) for i in items.collect() for t, s in every if i["id"] == t}
    assert [(-r["score"], r["id"]) for r in got.collect()] == sorted((-s, t) for t, _, s in rows)[:17]
    assert {tuple(r) for r in got.collect()} <= rows and got.distinct().count() == 17
    assert "BroadcastHashJoin" in plan(got)


def test_few_elements_go_to_the_triples(shuffled, monkeypatch):
    spark = shuffled
    triples = spark.createDataFrame([(f"{i:03d}", f"a{i % 9}", "is", f"b{i % 5}") for i in range(90)], "id string, subject string, predicate string, object string")
    rel = spark.createDataFrame([("a1", 0.5), ("b2", 0.7)], "source_element string, score double")
    wanted = {(f"{i:03d}", s) for i in range(90) for hit, s in ((i % 9 == 1, 0.5), (i % 5 == 2, 0.7)) if hit}
    for most, join in ((2, "BroadcastHashJoin"), (1, "SortMergeJoin")):
        monkeypatch.setattr(concepts, "SENT_ROWS", most)
        found = concepts.triples_of_elements(triples, concepts.sent_if_few(rel))
        assert join in plan(found) and {(r["id"], r["score"]) for r in found.collect()} == wanted
    assert "sent_if_few" in search.concept_triples.__code__.co_names


def test_counts_of_entities_are_written_without_a_shuffle(spark):
    rows = spark.createDataFrame([("a", "b", "s1", "ENTITY_ENTITY", 1, 0.5)] * 3, "subject string, object string, source string, type string, extracted_at int, confidence double")
    assert "Exchange" not in plan(entities.entity_counts(rows)) and entities.entity_counts(rows).agg(F.sum("n")).first()[0] == 6


def vectors_of(spark, vectors):
    return spark.createDataFrame(pd.DataFrame({"pos": range(len(vectors)), "embedding": [list(map(float, v)) for v in vectors]}), "pos long, embedding array<double>").withColumn("grp", F.lit("g"))


def test_rows_that_do_not_cluster_visit_few_cells(spark):
    """Vectors without clusters at a low threshold; a slice whose rows are all alike keeps numbers, not objects."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3_000, 16))
    rows = vectors_of(spark, vectors)
    assert metric_join.cells(rows, 0.3).count() <= (2 + metric_join.VISITS) * len(vectors)
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pairs = metric_join.similar_pairs(rows, 0.6).filter("a is not null")
    assert {(r["a"], r["b"]) for r in pairs.collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(u @ u.T >= 0.6, 1)))))


def test_many_searches_are_the_loop_of_each(spark, tmp_path, monkeypatch):
    """Copies of a vector tie and go by key; rows and queries in several parts and slices."""
    monkeypatch.setattr(vector_index, "PARTS", 5)
    monkeypatch.setattr(vector_index, "TASK_ROWS", 30)
    rng = np.random.default_rng(8)
    vectors = np.concatenate([rng.normal(size=(200, 8)), np.ones((50, 8))])
    vector_index.build(vectors_of(spark, vectors), f"file://{tmp_path}/ix", key="pos", dimension=8)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/ix")
    asked = vectors_of(spark, vectors[::4]).select(F.col("pos").alias("query"), F.col("embedding").alias("vector"))
    got = index.search_many(asked, 7, len(index.cells))
    assert "FlatMapCoGroupsInArrow" in plan(got)
    found = {}
    for r in got.orderBy("query", "place").collect():
        found.setdefault(r["query"], []).append(r["pos"])
    for i, v in enumerate(vectors[::4]):
        d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        assert found[i] == sorted(range(len(vectors)), key=lambda j: (d[j], j))[:7]


def test_a_predicate_of_all_triples_is_not_one_task(shuffled, monkeypatch):
    spark = shuffled
    triples = spark.createDataFrame([(f"{i % 30}", f"a{i}", "is" if i % 9 else "was", "b") for i in range(60)], "id string, subject string, predicate string, object string")
    dictionary = spark.createDataFrame([("is", 1), ("b", 2), ("a3", 3), ("a3 is b", 4)], "text string, embedding long")
    whole = {tuple(r) for r in store.vector_texts(triples).join(dictionary, "text").select("id", "vector_type", "text", "embedding").collect()}
    for most, join in ((1, True), (0, False)):
        monkeypatch.setattr(store, "SENT_TEXTS", most)
        found = store.known_texts(triples, dictionary)
        assert {tuple(r) for r in found.collect()} == whole and ("BroadcastHashJoin" in plan(found)) is join
    assert store.materialise_vectors(triples, dictionary).count() == found.count()


def test_asked_ids_are_what_a_task_keeps(shuffled):
    table = shuffled.createDataFrame([(f"{i % 50}",) for i in range(200)] + [(None,)], "id string")
    got = filters.ids_exist(table, shuffled.createDataFrame([("7",), ("7",), ("77",), (None,)], "id string"))
    assert got.count() == 3 and {tuple(r) for r in got.collect()} == {("7", True), ("77", False), (None, False)}
    assert "ShuffledHashJoin" in plan(got)


def test_rows_without_a_vector_are_not_written_again(spark, tmp_path, monkeypatch):
    """Most triples have no vector: exact dedup writes them, semantic dedup leaves them where they are."""
    rows = [(f"{i:04d}", f"s{i}", "p", "o", "T", f"g{i % 3}", float(i % 7), i) for i in range(300)]
    told = [(f"s{i} p o", [1.0, float(i % 4)]) for i in range(0, 300, 10)] + [("nothing such", [0.0, 1.0])]
    triples, dictionary = spark.createDataFrame(rows, TRIPLES), spark.createDataFrame(told, "text string, embedding array<double>")

    def staged(df):
        path = f"file://{tmp_path}/{len(written)}-{most}"
        df.write.parquet(path)
        written.append(spark.read.parquet(path))
        return written[-1]

    found = {}
    for most in (1_000, 0):
        monkeypatch.setattr(dedup, "SENT_HASHES", most)
        written = []
        found[most] = sorted(map(tuple, dedup.deduplicated(triples, dictionary, 0.99, stage=staged).select("id", "confidence", "extracted_at", "n_merged").collect()))
        sizes = [df.count() for df in written]
        assert sizes == [300, 31, 30 if most else 300, 6]
    assert found[1_000] == found[0] and len(found[0]) == 276 and sum(r[3] for r in found[0]) == 300


def test_texts_that_are_no_decimals_are_not_tried(spark):
    """The same as trying all of them."""
    texts = ["1", "-2.50", "+.5", "1e2", "1E-2", " 7 ", "\t8\n", "٣", "1234567", "e", "", "-", "1:2", "calm", "doc:1", "1d", "0x1", "NaN", "Infinity", None]
    rows = spark.createDataFrame([(t, t) for t in texts], "number string, time string").repartition(2)
    got = store.strict_casts(rows, {"number": "Decimal(5,2)", "time": "timestamp"})
    wanted = rows.select(F.col("number").try_cast("decimal(5,2)").alias("number"), F.col("time").try_cast("timestamp").alias("time"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))
    assert "RLIKE" in got._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_cut_some_texts_at_a_time(spark):
    docs = spark.createDataFrame([(i, "A sentence. " * i) for i in range(300)] + [(300, None), (301, " ")], "id int, text string")
    out = docs.select("id", chunking.chunk_column(F.col("text"), 100, 10).alias("c"))
    assert "BatchEvalPython" in plan(out) and "Arrow" not in plan(out)
    assert {r["id"]: [tuple(c) for c in r["c"]] for r in out.collect()} == {i: chunking.chunks(t, 100, 10) for i, t in docs.collect()}


def test_whole_triples_are_dealt_before_they_are_compared(shuffled):
    triples = shuffled.createDataFrame([(f"{i}", f"a{i % 7}", "is" if i % 3 else None, f"b{i % 11}") for i in range(200)] + [("x", None, None, None), ("y", "a", "is", "a")], "id string, subject string, predicate string, object string")
    dictionary = shuffled.createDataFrame([("is",), ("b2",), ("a3",), ("a3 is b2",), ("a1 b1",)], "text string")
    got = store.missing_texts(triples, dictionary)
    wanted = store.vector_texts(triples).select("vector_type", "text").distinct().join(dictionary, "text", "left_anti")
    key = lambda df: sorted((r["vector_type"], r["text"] or "") for r in df.select("vector_type", "text").collect())
    assert key(got) == key(wanted) and len(key(got)) > 80
    assert "REPARTITION_BY_COL" in plan(got)


def test_entity_relationship_and_fallback_searches_move_the_hits_rows(shuffled):
    """Of the triples, ids alone are shuffled; the rows found are those of the few hits that are sent to them."""
    triples = shuffled.createDataFrame([(f"t{i}", f"n{i}", "is", "b", None) for i in range(60)], "id string, subject string, predicate string, object string, source_date timestamp")
    said = shuffled.createDataFrame([(k, f"t{i}", f"c{i}", [float(i), 1.0]) for k in ("ENTITY", "RELATIONSHIP", "SEMANTIC", "CONCEPT") for i in range(40)],
                                    "vector_type string, knowledge_triple_id string, concept_node_id string, embedding array<double>")
    topics = shuffled.createDataFrame([(f"c{i}", f"topic {i}") for i in range(40)], "id string, concept string")
    hits, near, _ = search.search_with_fallback(triples, topics, said, [0.0, 1.0], -4.5, 3)
    none, instead, _ = search.search_with_fallback(triples, topics, said, [0.5, 1.0], 0.0, 3)
    for got in (search.search_entity_vector(triples, said, [0.0, 1.0], -4.5, 3), search.search_relationship_vector(triples, said, [0.0, 1.0], -4.5, 3), hits):
        assert [r["id"] for r in got.collect()] == ["t0", "t1", "t2"]
        assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin [item" in plan(got) and "SortMergeJoin [id" not in plan(got)
    assert near.count() == 0 and none.count() == 2 and instead.count() == 0
    assert [r["id"] for r in search.search_with_fallback(triples, topics, said, [0.0, 9.0], -7.5, 3)[1].collect()] == []
    far = said.withColumn("embedding", F.when(F.col("vector_type") == "SEMANTIC", F.array(F.lit(9.0), F.lit(9.0))).otherwise(F.col("embedding")))
    assert [r["id"] for r in search.search_with_fallback(triples, topics, far, [0.0, 1.0], 0.0, 3)[1].collect()] == ["c0", "c1"]
