"""The trigram index against the scan that it stands for."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import search, text_index

SCHEMA = "id string, subject string, predicate string, object string, type string"


def made(n, seed=1):
    rng = np.random.default_rng(seed)
    words = ["Alder", "birch", "CEDAR", "elm", "Æsh", "日本語", "😀x", "a%b_c", "\\q", ""]
    name = lambda: " ".join(words[i] for i in rng.integers(0, len(words), 2)) + f":{rng.integers(0, 400)}"
    rows = [(f"{i:05d}", name(), "knows", name(), "ENTITY_ENTITY") for i in range(n)]
    return rows + [("n1", None, "knows", "birch", "x"), ("n2", "elm", None, None, None), ("n3", "", "", "", "x"), *[("t", "twin birch:7", "is", "twin", "x")] * 3]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame(made(4_000), SCHEMA).withColumn("gram", F.lit("clash")).withColumn("value", F.lit(1))
    path = str(tmp_path_factory.mktemp("texts") / "index")
    text_index.build(rows, path, slots=64)
    return rows, text_index.TextIndex(spark, path)


@pytest.mark.parametrize("query", ["birch:12", "BIRCH elm:3", "日本語 elm", "語 æsh", "😀x:7", "a%b_c elm", "\\q Ced", "twin", "nothing such", "el", "", "elm:1", "x:39 zzz twin"])
def test_candidates_hold_every_match(indexed, query):
    rows, index = indexed
    for q, fields in (([query], None), (query.split(), ["subject", "object"])):
        hit = search.contains_any([F.col(c) for c in fields or text_index.FIELDS], q)
        got, wanted = index.candidates(q, fields).filter(hit), rows.filter(hit)
        assert got.columns == rows.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_reads_follow_the_candidates(indexed):
    """A rare name reads its slots alone; a name in a tenth of all rows reads them all."""
    rows, index = indexed
    for q in ("twin", "cedar:311"):
        got = index.candidates([q])
        plan = got._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[[^]]*slot#", plan)
        slots = {r[0] for r in index.places(index.probes([q])).select(F.pmod("place", F.lit(64))).collect()}
        read = index.rows(sorted(slots)).count()
        assert got.count() <= read <= len(slots) * 3 * 4_000 / 64 and read < 1_000
    assert index.probes(["knows"]) is None and index.probes(["elm"]) is None


def test_batches_add_up(spark, tmp_path):
    """Three batches, an empty one among them, and one whose counts never came."""
    path = str(tmp_path / "index")
    parts = [spark.createDataFrame(made(300, seed), SCHEMA) for seed in (1, 2)]
    text_index.build(parts[0].limit(0), path, slots=4)
    index = text_index.TextIndex(spark, path)
    assert index.candidates(["elm:1"]).count() == 0 and index.rows().count() == 0
    index.append(parts[0])
    index.append(parts[1])
    both = parts[0].unionByName(parts[1])
    hit = search.contains_any([F.col(c) for c in text_index.FIELDS], ["elm:10"])
    again = text_index.TextIndex(spark, path)
    assert again.total == both.count()
    assert sorted(map(repr, again.candidates(["elm:10"]).filter(hit).collect())) == sorted(map(repr, both.filter(hit).collect()))
    parts[0].write.parquet(f"{path}/rows/batch=broken")
    assert text_index.TextIndex(spark, path).total == both.count()


def test_own_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        text_index.build(spark.createDataFrame(made(3), SCHEMA).withColumn("Slot", F.lit(1)), str(tmp_path / "index"))


def test_rows_stay_and_texts_move_once_for_a_slot(spark, tmp_path):
    """Rows are written in their order, without a shuffle; a text that a slot's rows repeat is one entry."""
    rows = spark.createDataFrame([(f"{i:04d}", f"Alder:{i // 100}", "knows", "birch", "x") for i in range(2_000)], SCHEMA).coalesce(1)
    path = str(tmp_path / "index")
    text_index.build(rows, path, slots=20)
    index = text_index.TextIndex(spark, path)
    runs = spark.read.parquet(f"{path}/rows").groupBy("slot").agg(F.collect_list("id").alias("ids")).collect()
    assert all(int(b) - int(a) == 1 or int(b) % 100 == 0 for r in runs for a, b in zip(sorted(r["ids"]), sorted(r["ids"])[1:]) if int(b) // 100 == int(a) // 100)
    entries = spark.read.parquet(f"{path}/entries")
    assert entries.count() == 20 + 2 * len(runs) and entries.agg(F.sum("n")).first()[0] == 6_000
    assert index.candidates(["alder:13"]).filter("subject = 'Alder:13'").count() == 100 and index.candidates(["alder:13"]).count() < 1_000
