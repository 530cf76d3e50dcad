"""Places in groups of any size, and what is cut by them."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import concepts, extract
from factloom.operators.numbering import numbered


def test_places_over_many_ranges(spark):
    """A group with two thirds of all rows, a null group, nulls in the order, one range and seven."""
    rows = [("hot" if i % 3 else f"g{i % 7}" if i % 2 else None, None if i == 600 else (i * 7919) % 2000) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int")
    wanted = defaultdict(list)
    for g, v in sorted(rows, key=lambda r: (r[0] or "", r[1] is not None, r[1] or 0)):
        wanted[g].append(v)
    for parts in (1, 7):
        got = numbered(df, ["g"], ["v"], parts=parts)
        assert got.columns == ["g", "v", "place"]
        rows_of = sorted(got.collect(), key=lambda r: r["place"])
        for g in wanted:
            mine = [(r["place"], r["v"]) for r in rows_of if r["g"] == g]
            assert [p for p, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == wanted[g]


def test_one_group_of_all_rows(spark):
    """One group of all rows, in eight ranges."""
    got = numbered(spark.range(8_000).withColumn("g", F.lit("one")), ["g"], ["id"], parts=8)
    assert got.filter("place <> id").count() == 0 and got.count() == 8_000


def test_odd_tables(spark):
    assert numbered(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0
    assert sorted(r["place"] for r in numbered(spark.createDataFrame([("a", 1)] * 3, "g string, v int"), ["g"], ["v"]).collect()) == [0, 1, 2]  # ties
    with pytest.raises(ValueError):
        numbered(spark.createDataFrame([("a", 1)], "part string, v int"), ["part"], ["v"])


def test_prompts_and_ids_are_bounded(spark):
    sets = spark.createDataFrame([("s", "entity", f"e{i}") for i in range(5)] + [("s", "event", "v0"), ("t", "event", "v1"), ("t", "event", None)], "source string, kind string, text string")
    got = {(r["source"], r["part"]): r["prompt"].split("\n")[1:] for r in extract.concept_prompt(sets, "source", most=2).collect()}
    assert got == {
        ("s", 0): ["Entities: e0, e1", "Events: v0", "Relationships: "], ("s", 1): ["Entities: e2, e3", "Events: ", "Relationships: "],
        ("s", 2): ["Entities: e4", "Events: ", "Relationships: "], ("t", 0): ["Entities: ", "Events: v1", "Relationships: "],
    }
    triples = spark.createDataFrame([("s", f"{i:02d}") for i in range(5)], "source string, id string")
    ids = {r["part"]: r["triple_ids"] for r in concepts.triple_ids(triples, "source", most=3).collect()}
    assert ids == {0: ["00", "01", "02"], 1: ["03", "04"]}
