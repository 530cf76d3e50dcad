"""Entities and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import TRIPLE_TYPES
from .filters import Scope

SORTS = {"frequency": lambda: [F.desc("occurrences")], "alphabetical": lambda: [F.collate("entity", "UNICODE")], "recent": lambda: [F.desc("last_seen")]}


def enumerate_entities(triples: DataFrame, scope: Scope = Scope(), role: str = "both", min_occurrence: int = 1, sort: str = "frequency", limit: int | None = None) -> DataFrame:
    """Per entity: occurrences, roles, sources, types of the schema, last extraction, best confidence.

    A triple from an entity to itself counts twice under ``both``.  Roles and types go as
    flags and bits through two hash aggregations, by entity and source, then by entity.
    """
    rows = _named_entities(scope.apply(triples), role)
    return _enumerated(rows, F.count(F.lit(1)), role, min_occurrence, sort, limit)


ROLES = {"subject": 1, "object": 2}


def _roles(role: str) -> dict[str, int]:
    return ROLES if role == "both" else {role: ROLES[role]}


def _named_entities(triples: DataFrame, role: str) -> DataFrame:
    """A row for each entity and role of a triple; roles and types as bits."""
    pairs = F.array(*[F.struct(F.col(r).alias("entity"), F.lit(k).alias("role")) for r, k in _roles(role).items()])
    bit = F.call_function("shiftleft", F.lit(1), F.array_position(F.array(*map(F.lit, TRIPLE_TYPES)), F.col("type")).cast("int"))
    return triples.select(F.explode(pairs).alias("named"), "source", bit.alias("type"), "extracted_at", "confidence").select("named.*", "source", "type", "extracted_at", "confidence")


def entity_counts(triples: DataFrame) -> DataFrame:
    """How often each entity comes in each role, source, type, time and confidence: counts that add up over publications.

    A row for each mention, since these columns hardly repeat: grouping would shuffle them all to
    write little less, and who reads the counts adds them up anyway.  Each task sorts its own,
    so that names and sources stand beside their like: files take less, and so does the
    shuffle that deals them by ``COUNTED_BY``.
    """
    return _named_entities(triples, "both").withColumn("n", F.lit(1).cast("long")).sortWithinPartitions(*COUNTED_BY)


def enumerate_counted(counts: DataFrame, role: str = "both", min_occurrence: int = 1, sort: str = "frequency", limit: int | None = None) -> DataFrame:
    """``enumerate_entities`` of the triples that ``entity_counts`` has counted."""
    rows = counts if role == "both" else counts.filter(F.col("role") == ROLES[role])
    return _enumerated(rows, F.sum("n"), role, min_occurrence, sort, limit)


COUNTED_BY = ("entity", "source")  # by which counts of entities are dealt, so that adding up and enumerating take one shuffle


def kind_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("type", "source").agg(F.count(F.lit(1)).alias("n"))


def level_counts(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("abstraction_level", "source").agg(F.count(F.lit(1)).alias("n"))


def stats_counted(kinds: DataFrame, levels: DataFrame) -> DataFrame:
    """``graph_stats`` of what ``kind_counts`` and ``level_counts`` have counted."""
    total = lambda name: F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(name)
    found = kinds.agg(total("total_triples"), F.countDistinct("type").alias("n_types"), F.countDistinct("source").alias("n_sources"))
    return found.crossJoin(levels.agg(total("total_concepts")))  # one row each


def _enumerated(rows: DataFrame, n, role: str, min_occurrence: int, sort: str, limit: int | None) -> DataFrame:
    both = [F.bit_or("role").alias("role"), F.bit_or("type").alias("type"), F.max("extracted_at").alias("extracted_at"), F.max("confidence").alias("confidence")]
    by_source = rows.groupBy("entity", "source").agg(n.alias("n"), *both)
    out = by_source.groupBy("entity").agg(F.sum("n").alias("occurrences"), F.count("source").alias("n_sources"), *both).filter(F.col("occurrences") >= min_occurrence)
    named = lambda bits, names: F.concat_ws(",", *[F.when(F.col(bits).bitwiseAND(F.lit(k)) != 0, n) for n, k in sorted(names.items())])
    out = out.select(
        "entity", "occurrences", named("role", _roles(role)).alias("roles"), "n_sources",
        named("type", {t: 2 << i for i, t in enumerate(TRIPLE_TYPES)}).alias("types"), F.col("extracted_at").alias("last_seen"), F.col("confidence").alias("best_confidence"),
    )
    out = out.orderBy(*SORTS[sort](), "entity")
    return out.limit(limit) if limit else out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """One row with the sorted array of a column's few values, such as vector types or sources of a report."""
    return df.select(column).distinct().agg(F.array_sort(F.collect_set(column)).alias("found"))


def temporal_clusters(triples: DataFrame) -> DataFrame:
    """(period, n, first, last) by month of the source date; rows without one don't count."""
    return triples.filter("source_date is not null").groupBy(F.date_format("source_date", "yyyy-MM").alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.min("source_date").alias("first_date"), F.max("source_date").alias("last_date")
    )


def triples_by_type(triples: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts with a row for every type, 0 where there is none."""
    spark = triples.sparkSession
    every = spark.createDataFrame([(k,) for k in kinds], "type string")
    return F.broadcast(every).join(triples.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def graph_stats(triples: DataFrame, concepts: DataFrame) -> DataFrame:
    kinds = triples.agg(F.count(F.lit(1)).alias("total_triples"), F.countDistinct("type").alias("n_types"), F.countDistinct("source").alias("n_sources"))
    return kinds.crossJoin(concepts.agg(F.count(F.lit(1)).alias("total_concepts")))  # one row each


def embedding_map_stats(triples: DataFrame, concepts: DataFrame, batch: int = 100) -> DataFrame:
    """How many texts an embedding stage needs, and how many repeats a dictionary saves."""
    parts = F.array("subject", "predicate", "object", F.concat_ws(" ", "subject", "predicate", "object"))
    texts = triples.select(F.explode(parts).alias("text")).unionByName(concepts.select(F.col("concept").alias("text")))
    # two plain aggregates: a distinct count beside a count would expand every row
    n, unique = texts.agg(F.count(F.lit(1)).alias("total_texts")), texts.distinct().agg(F.count(F.lit(1)).alias("unique_texts"))
    return n.crossJoin(unique).select(
        "total_texts", "unique_texts", F.greatest(F.lit(0), F.col("total_texts") - F.col("unique_texts")).alias("duplicates_averted"),
        F.ceil(F.col("unique_texts") / batch).alias("batch_calls"),
    )
