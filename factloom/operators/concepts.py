"""Triples and the concepts of their elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TRIPLE_KEY
from .numbering import numbered


def elements(triples: DataFrame) -> DataFrame:
    """One row for each triple and each different element of it."""
    return triples.withColumn("element", F.explode(F.array_distinct(F.array("subject", "object", "predicate"))))


SENT_ROWS = 500_000  # of elements with their scores that are sent to the triples; more are met by a shuffle


def sent_if_few(rel: DataFrame) -> DataFrame:
    """``rel``, which is read twice, to be sent to every task if it has at most SENT_ROWS rows: three elements of every triple needn't be shuffled then."""
    return F.broadcast(rel) if rel.limit(SENT_ROWS + 1).count() <= SENT_ROWS else rel


def triples_of_elements(triples: DataFrame, rel: DataFrame) -> DataFrame:
    """Join on "subject, object or predicate is the element".

    An OR in the condition would plan as a nested loop; one row for each element makes
    it an equi-join.  ``rel``: source_element and whatever goes to the result.
    """
    found = elements(triples).join(rel, F.col("element") == F.col("source_element"))
    return found.drop("element", "source_element").distinct()


def triples_of_concept(triples: DataFrame, conceptualizations: DataFrame, concept: str) -> DataFrame:
    els = conceptualizations.filter(F.col("concept") == concept).select("source_element").distinct()
    keys = elements(triples).join(els, F.col("element") == F.col("source_element"), "left_semi").select(*TRIPLE_KEY).distinct()
    return triples.join(keys, TRIPLE_KEY, "left_semi")


def context_triples(triples: DataFrame, conceptualizations: DataFrame, most: int = 5, by: list[str] = ()) -> DataFrame:
    """(source_element, concept, id, rank, and ``by``): the first triples of each relationship's element.

    With ``by``, columns of both such as the source, elements are those of its own group:
    what another source says of one isn't its context.
    """
    names = [f"_{c}" for c in by]
    els = conceptualizations.select("source_element", *[F.col(c).alias(n) for c, n in zip(by, names)]).distinct()
    same = F.col("element") == F.col("source_element")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    found = elements(triples).join(els, same)
    first = Window.partitionBy("source_element", *names).orderBy("id")
    ranked = found.select("source_element", "id", *names).withColumn("rank", F.dense_rank().over(first)).filter(F.col("rank") <= most).distinct()  # an id is named once
    of = conceptualizations.select("source_element", "concept", *by).distinct()
    for n, c in zip(names, by):
        ranked = ranked.withColumnRenamed(n, f"{n}2")
    ranked = ranked.withColumnRenamed("source_element", "_element")
    same = F.col("source_element") == F.col("_element")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(f"{n}2"))
    return of.join(ranked, same).select("source_element", "concept", "id", "rank", *by)


def element_parts(triples: DataFrame, *carried: str) -> DataFrame:
    """(kind, text, and the carried columns): each triple's entities, events and relationship."""
    t = F.col("type")
    subject_kind = F.when(t.isin("ENTITY_ENTITY", "ENTITY_EVENT"), "entity").otherwise("event")
    object_kind = F.when(t == "ENTITY_ENTITY", "entity").otherwise("event")
    parts = F.array(
        F.struct(subject_kind.alias("kind"), F.col("subject").alias("text")),
        F.struct(object_kind.alias("kind"), F.col("object").alias("text")),
        F.struct(F.lit("relationship").alias("kind"), F.col("predicate").alias("text")),
    )
    return triples.select(F.explode(parts).alias("e"), *carried).select("e.*", *carried)


def element_sets(triples: DataFrame, *by: str) -> DataFrame:
    """(kind, text): the distinct entities, events and relationships that a concept stage asks about, by the given columns."""
    return element_parts(triples, *by).distinct()


def triple_ids(triples: DataFrame, *by: str, most: int = 10_000) -> DataFrame:
    """The ids of a job's triples as sorted arrays of at most ``most``, numbered by ``part`` from 0, as a concept stage takes them along."""
    placed = numbered(triples.select(*by, "id"), list(by), ["id"])
    cut = placed.withColumn("part", F.floor(F.col("place") / most).cast("int"))
    return cut.groupBy(*by, "part").agg(F.array_sort(F.collect_list("id")).alias("triple_ids"))
