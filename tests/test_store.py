"""The store's merge on read: deletes, upserts, compaction, and publishers that meet."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.graph import KnowledgeGraph
from factloom.operators import concepts, dedup, store
from factloom.operators.model import Extracted
from factloom.schema import TRIPLE_KEY, TRIPLES

KV = {"t": "k string, v int"}


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, f"file://{tmp_path}/s")


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KV["t"])


def held(s):
    return sorted(((r["k"], r["v"]) for r in s.read("t", KV["t"]).collect()), key=str)


def test_deletes_and_upserts_write_what_the_batch_holds(spark, kept):
    kept.publish({"t": rows(spark, *[(f"k{i:06d}", i) for i in range(20_000)])}, None, KV)
    (first,) = kept.manifest()[1]["t"]["data"]
    kept.publish({}, None, KV, deleted={"t": rows(spark, ("k000003", 0), ("none", 0)).select("k")})
    kept.upsert("t", rows(spark, ("k000004", -4), ("k000004", -5), ("new", 1)), ["k"], KV)
    table = kept.manifest()[1]["t"]
    assert table["data"][0] == first  # the large folder is as it was
    written = sum(kept.size(f) for f in [d[0] for d in table["data"][1:]] + [d["folder"] for d in table["deletes"]])
    assert written * 20 < kept.size(first[0])
    now = dict(held(kept))
    assert len(now) == 20_000 and "k000003" not in now and now["k000004"] == -4 and now["new"] == 1
    kept.publish({"t": rows(spark, ("k000003", 33))}, None, KV)  # stored again after its delete
    assert dict(held(kept))["k000003"] == 33


def test_null_keys_are_deleted_like_others(spark, kept):
    kept.publish({"t": rows(spark, (None, 1), ("a", 2))}, None, KV)
    kept.publish({}, None, KV, deleted={"t": rows(spark, (None, 0)).select("k")})
    assert held(kept) == [("a", 2)]


def test_compaction_merges_the_smallest_and_forgets_old_deletes(spark, kept, monkeypatch):
    monkeypatch.setattr(store.Store, "FOLDERS", 4)
    monkeypatch.setattr(store.Store, "DELETES", 2)
    kept.publish({"t": rows(spark, *[(f"big{i}", i) for i in range(5000)])}, None, KV)
    (big,) = kept.manifest()[1]["t"]["data"]
    want = {f"big{i}": i for i in range(5000)}
    for n in range(9):
        kept.publish({"t": rows(spark, (f"x{n}", n))}, None, KV, deleted={"t": rows(spark, (f"x{n - 1}", 0), (f"big{n}", 0)).select("k")})
        want.pop(f"x{n - 1}", None), want.pop(f"big{n}")
        want[f"x{n}"] = n
        assert dict(held(kept)) == want
    table = kept.manifest()[1]["t"]
    assert len(table["data"]) <= 4 and len(table["deletes"]) <= 3 and big in table["data"]


def test_a_delete_from_an_earlier_manifest_meets_merged_rows(spark, kept, monkeypatch):
    """Folders are merged between a publisher's reading and its delete; what was added meanwhile stays."""
    kept.publish({"t": rows(spark, ("a", 1), ("b", 1))}, None, KV)
    kept.publish({"t": rows(spark, ("c", 1))}, None, KV)
    seen = kept.manifest()[0]
    monkeypatch.setattr(store.Store, "FOLDERS", 2)
    kept.publish({"t": rows(spark, ("d", 1))}, None, KV)
    kept.publish({"t": rows(spark, ("a", 9))}, None, KV)
    assert len(kept.manifest()[1]["t"]["data"]) == 2
    kept.publish({}, None, KV, deleted={"t": rows(spark, ("a", 0), ("c", 0), ("d", 0)).select("k")}, as_of=seen)
    assert held(kept) == [("a", 9), ("b", 1), ("d", 1)]


def test_two_publishers_of_one_key(spark, kept):
    """Both have looked before either wrote: the key is stored once."""
    kept.publish({"t": rows(spark, ("a", 1))}, None, KV)
    seen = kept.manifest()[0]
    for v in (1, 2):
        kept.publish({"t": rows(spark, ("k", v), (f"own{v}", v))}, None, KV, keys={"t": ["k"]}, as_of=seen)
    assert held(kept) == [("a", 1), ("k", 1), ("own1", 1), ("own2", 2)]


# -- identity and contexts

def test_triples_that_share_an_id_are_two(spark, tmp_path):
    """``ab?`` and ``ab>`` have one id; merging and deleting go by the four columns."""
    raw = [("ab?", "p", "o", "X"), ("ab?", "p", "o", "Y"), ("ab>", "p", "o", "X"), ("other", "p", "o", "X")]
    table = spark.createDataFrame([("", *r, "s", "file", None, None, None) for r in raw], TRIPLES).withColumn("source_root", F.lit("s"))
    table = store.cleaned_triples(table)
    ids = {(r["subject"], r["type"]): r["id"] for r in table.collect()}
    assert ids["ab?", "X"] == ids["ab>", "X"] != ids["ab?", "Y"]
    vectors = spark.createDataFrame([("ab? p o", [1.0, 0.0]), ("ab> p o", [0.0, 1.0]), ("other p o", [0.0, 0.99])], "text string, embedding array<double>")
    kept = dedup.deduplicated(table, vectors, 0.9)
    # the type doesn't tell texts apart; the two with one id do not merge with each other
    assert sorted(r["n_merged"] for r in kept.collect()) == [2, 2] and {r["subject"][:2] for r in kept.collect()} <= {"ab", "ot"}
    gone = store.duplicates_of(table, kept)
    left = {(r["subject"], r["type"]) for r in store.delete_triples(table, table.select(F.col("id").alias("knowledge_triple_id")), gone)[0].collect()}
    assert left == {(r["subject"], r["type"]) for r in kept.collect()} and len(left) == 2


def test_dedup_job_of_triples_that_share_an_id(spark, tmp_path):
    said = [("ENTITY_ENTITY", "ab?", "p", "o", 0.5), ("ENTITY_ENTITY", "ab>", "p", "o", 0.5), ("ENTITY_EVENT", "ab?", "p", "o", 0.9)]
    embed = lambda texts: np.array([[1.0 if "?" in t else 0.0, 0.0 if "?" in t else 1.0] + [0.0] * 62 for t in texts])
    g = KnowledgeGraph(spark, f"file://{tmp_path}/g", extractor=lambda text, kinds: Extracted(said), embedder=embed, semantic_dedup=0.9)
    g.process_knowledge(spark.createDataFrame([("1", "text", "s", "file")], "id string, text string, source string, source_type string"), "2025-01-01 00:00:00")
    left = {(r["subject"], float(r["confidence"])) for r in g.table("triples").collect()}
    assert left == {("ab?", 0.9), ("ab>", 0.5)}
    texts = {r["text"] for r in g.table("vectors").filter("vector_type = 'SEMANTIC'").collect()}
    assert texts == {"ab? p o", "ab> p o"}  # the shared id's vectors go by what they stand for


def test_contexts_stay_within_their_source(spark):
    made = [(f"a{i}", "Alice", "p", f"o{i}", "X", "A", "file") for i in range(7)] + [("b1", "Alice", "p", "q", "X", "B", "file"), ("b2", "Bob", "p", "Alice", "X", "B", None)]
    triples = spark.createDataFrame(made, "id string, subject string, predicate string, object string, type string, source string, source_type string")
    links = spark.createDataFrame([("Alice", "person", "A", "file"), ("Alice", "person", "B", "file"), ("Alice", "person", "B", None)], "source_element string, concept string, source string, source_type string")
    got = concepts.context_triples(triples, links, by=["source", "source_type"]).collect()
    ids = lambda s, t: sorted(r["id"] for r in got if (r["source"], r["source_type"]) == (s, t))
    assert (ids("A", "file"), ids("B", "file"), ids("B", None)) == ([f"a{i}" for i in range(5)], ["b1"], ["b2"])


def test_failures_other_than_vectors_are_not_swallowed(spark):
    table = spark.createDataFrame([("1", "a", "p", "b", "X", "s", "file", None, None, None)], TRIPLES).withColumn("source_root", F.lit("s"))

    def broken(df):
        if broken.again:
            raise RuntimeError("stage cancelled")
        broken.again = True
        return df

    broken.again = False
    with pytest.raises(RuntimeError, match="cancelled"):
        dedup.deduplicated(table, spark.createDataFrame([("a p b", [1.0])], "text string, embedding array<double>"), 0.9, stage=broken)


# -- membership filters and views

NAMED = {"t": "k string, v int, w string"}


def named_rows(spark, *made):
    return spark.createDataFrame(list(made), NAMED["t"])


def test_new_rows_read_only_folders_that_can_hold_a_key(spark, tmp_path, monkeypatch):
    s = store.Store(spark, f"file://{tmp_path}/s", {"t": ["k", "v"]})
    for n in range(10):
        s.publish({"t": named_rows(spark, *[(f"k{n}-{i}", i, "w") for i in range(300)])}, None, NAMED)
    s.publish({}, None, NAMED, deleted={"t": named_rows(spark, ("k7-1", 1, "")).select("k", "v")})
    batch = named_rows(spark, ("k3-5", 5, "again"), ("k3-5", 6, "other v"), ("new", 1, "x"), ("new", 1, "y"), ("k7-1", 1, "deleted before"), (None, 1, "n"))
    folders = [d[0] for d in s.manifest()[1]["t"]["data"]]
    assert s.may_hold("t", batch, NAMED["t"]) == sorted([folders[3], folders[7]])  # 8 of 10 are skipped
    read = []
    rows = s._rows
    monkeypatch.setattr(s, "_rows", lambda data, *a: read.extend(data) or rows(data, *a))
    got = sorted((r["k"] or "", r["v"]) for r in s.new_rows("t", batch, NAMED["t"]).collect())
    assert got == [("", 1), ("k3-5", 6), ("k7-1", 1), ("new", 1)] and len(read) == 2
    same = store.new_rows(batch, s.read("t", NAMED["t"]), ["k", "v"])
    assert got == sorted((r["k"] or "", r["v"]) for r in same.collect())
    assert s.may_hold("t", batch.filter("k = 'new'"), NAMED["t"]) == []
    # a batch whose column has another type meets the same keys
    assert s.may_hold("t", batch.filter("w = 'again'").withColumn("v", F.col("v").cast("long")), NAMED["t"]) == [folders[3]]


def test_filters_follow_compaction_and_folders_without_one_are_read(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    store.Store(spark, root).publish({"t": named_rows(spark, ("old", 1, "w"))}, None, NAMED)  # knows of no key
    s = store.Store(spark, root, {"t": ["k"]})
    monkeypatch.setattr(store.Store, "FOLDERS", 4)
    for n in range(6):
        s.publish({"t": named_rows(spark, *[(f"k{n}-{i}", i, "w") for i in range(50 * n + 1)])}, None, NAMED)
    batch = named_rows(spark, ("old", 2, ""), ("k0-0", 2, ""), ("k5-9", 2, ""), ("new", 2, ""))
    assert len(s.manifest()[1]["t"]["data"]) <= 4
    assert [r["k"] for r in s.new_rows("t", batch, NAMED["t"]).collect()] == ["new"]
    for v in (1, 2):  # two publishers of one key
        s.publish({"t": named_rows(spark, ("both", v, ""))}, None, NAMED, keys={"t": ["k"]}, as_of=s.manifest()[0] - v + 1)
    assert s.read("t", NAMED["t"]).filter("k = 'both'").count() == 1
    assert s.new_rows("t", named_rows(spark, ("both", 3, "")), NAMED["t"]).isEmpty()


def by_w(rows):
    return rows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("n"))


def test_views_equal_counts_of_the_rows(spark, tmp_path, monkeypatch):
    """After appends, deletes, upserts, a clash of two publishers, merging and replacing."""
    monkeypatch.setattr(store.Store, "FOLDERS", 3)
    s = store.Store(spark, f"file://{tmp_path}/s", {"t": ["k"]}, {"t": {"by_w": by_w}})
    said = lambda df: sorted((r["w"] or "", r["v"], r["n"]) for r in df.collect())
    check = lambda: said(s.view("t", "by_w", NAMED["t"])) == said(by_w(s.read("t", NAMED["t"])))
    assert said(s.view("t", "by_w", NAMED["t"])) == []
    make = lambda n: named_rows(spark, *[(f"k{i}", i % 3, None if i % 5 == 0 else f"w{i % 4}") for i in range(20 * n, 20 * n + 20)])
    s.publish({"t": make(0)}, None, NAMED)
    assert check()
    seen = s.manifest()[0]
    s.publish({"t": make(1)}, None, NAMED, deleted={"t": named_rows(spark, ("k3", 0, ""), ("k19", 0, ""), ("none", 0, "")).select("k")})
    assert check()
    s.publish({}, None, NAMED, deleted={"t": named_rows(spark, ("k3", 0, ""), ("k4", 0, ""), ("k25", 0, "")).select("k")}, as_of=seen)  # k3 is gone, k25 came later
    assert check() and s.read("t", NAMED["t"]).filter("k in ('k3', 'k4', 'k25')").count() == 1
    s.upsert("t", named_rows(spark, ("k5", 9, "up"), ("k99", 9, "up")), ["k"], NAMED)
    assert check()
    s.publish({"t": named_rows(spark, ("k99", 1, "late"), ("k98", 1, "late"))}, None, NAMED, keys={"t": ["k"]}, as_of=seen)
    assert check() and s.read("t", NAMED["t"]).filter("w = 'late'").count() == 1
    assert len(s.manifest()[1]["t"]["views"]["by_w"]) <= 3  # merged as well
    s.publish({}, {"t": lambda rows: rows.filter("v = 1")}, NAMED)
    assert check() and len(s.manifest()[1]["t"]["views"]["by_w"]) == 1


def test_views_are_read_instead_of_rows_and_made_for_older_tables(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    store.Store(spark, root).publish({"t": named_rows(spark, ("a", 1, "x"), ("b", 1, "x"))}, None, NAMED)  # without views
    s = store.Store(spark, root, {}, {"t": {"by_w": by_w}})
    assert [tuple(r) for r in s.view("t", "by_w", NAMED["t"]).collect()] == [("x", 1, 2)]
    s.publish({"t": named_rows(spark, ("c", 1, "x"))}, None, NAMED)
    monkeypatch.setattr(s, "_rows", None)
    assert [tuple(r) for r in s.view("t", "by_w", NAMED["t"]).collect()] == [("x", 1, 3)]


def test_graph_statistics_follow_dedup(spark, tmp_path):
    said = [("ENTITY_ENTITY", "ab?", "p", "o", 0.5), ("ENTITY_ENTITY", "ab>", "p", "o", 0.5), ("ENTITY_EVENT", "ab?", "p", "ab?", 0.9)]
    embed = lambda texts: np.array([[1.0 if "?" in t else 0.0, 0.0 if "?" in t else 1.0] + [0.0] * 62 for t in texts])
    g = KnowledgeGraph(spark, f"file://{tmp_path}/g", extractor=lambda text, kinds: Extracted(said), embedder=embed, semantic_dedup=0.9)
    from factloom.operators import entities

    for n in range(2):
        g.process_knowledge(spark.createDataFrame([(str(n), "text", f"s{n}", "file")], "id string, text string, source string, source_type string"), f"2025-01-0{n + 1} 00:00:00")
        want = entities.graph_stats(g.table("triples"), g.table("concepts")).first()
        got = g.get_knowledge_graph_stats().first()
        assert tuple(got[c] for c in want.asDict()) == tuple(want) and want["total_triples"] > 0
        assert sum(got["triples_by_type"].values()) == want["total_triples"]
        for role in ("both", "subject", "object"):
            assert g.enumerate_entities(role).collect() == entities.enumerate_entities(g.table("triples"), role=role).collect()
