"""Keyword, concept and vector searches; every order ends with the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, search_terms
from ..functions.vector import literal, similarity
from .concepts import sent_if_few, triples_of_elements
from .entities import temporal_clusters
from .filters import Scope


def search_text(triples: DataFrame, query: str, limit: int = 50) -> DataFrame:
    hit = contains_any([F.col(c) for c in ("subject", "predicate", "object")], [query])
    return triples.filter(hit).orderBy("id").limit(limit)


def search_entity(triples: DataFrame, query: str, scope: Scope = Scope(), limit: int = 10, exact_first: bool = False) -> DataFrame:
    """Any term in subject or object; the names themselves order the result, descending."""
    hit = contains_any([F.col("subject"), F.col("object")], search_terms(query))
    exact = [F.desc((F.lower("subject") == query.lower()) | (F.lower("object") == query.lower()))] if exact_first else []
    return scope.apply(triples.filter(hit)).orderBy(*exact, F.desc("subject"), F.desc("object"), F.desc("extracted_at"), "id").limit(limit)


def search_relationship(triples: DataFrame, query: str, scope: Scope = Scope(), limit: int = 10) -> DataFrame:
    hit = contains_any([F.col("predicate")], search_terms(query))
    return scope.apply(triples.filter(hit)).orderBy(F.desc("predicate"), F.desc("extracted_at"), "id").limit(limit)


def search_concept_text(triples: DataFrame, conceptualizations: DataFrame, query: str, scope: Scope = Scope(), limit: int = 10) -> DataFrame:
    """Triples with an element of a concept like ``query``, in which % and _ are wildcards."""
    rel = conceptualizations.filter(F.col("concept").ilike(f"%{query}%"))
    found = triples_of_elements(scope.apply(triples), rel.select("source_element", F.col("confidence").alias("concept_confidence")))
    return found.distinct().orderBy(F.desc_nulls_last("concept_confidence"), F.desc("extracted_at"), "id").limit(limit)


def search_concepts(concepts: DataFrame, query: str, level: str | None = None, limit: int = 50) -> DataFrame:
    found = concepts.filter(contains_any([F.col("concept")], [query]))
    if level:
        found = found.filter(F.col("abstraction_level") == level.upper())
    return found.orderBy("id").limit(limit)


def nearest(items: DataFrame, vectors: DataFrame, vector: list[float], vector_type: str, key: str, min_score: float, limit: int,
            scope: Scope = Scope(), metric: str = "l2") -> DataFrame:
    """Top ``limit`` items by the similarity of their vectors of one type.

    The vectors are filtered by type and score, and meet the items' ids alone; each pair of
    item and score gives a row at least, so the first ``limit`` pairs lead to all rows of the
    result, and of the items' other columns only theirs are moved.
    """
    scored = vectors.filter(F.col("vector_type") == vector_type).select(
        F.col(key).alias("item"), similarity(F.col("embedding"), literal(vector), metric).alias("score")
    ).filter(F.col("score") >= min_score)
    there = scored.join(scope.apply(items).select(F.col("id").alias("item")), "item", "left_semi")
    best = there.distinct().orderBy(F.desc("score"), "item").limit(limit)
    found = scope.apply(items).join(F.broadcast(best), F.col("id") == F.col("item")).drop("item").distinct()  # best has `limit` rows
    return found.orderBy(F.desc("score"), "id").limit(limit)


def search_semantic(triples, vectors, vector, min_score=0.7, limit=10, scope=Scope(), metric="l2") -> DataFrame:
    return nearest(triples, vectors, vector, "SEMANTIC", "knowledge_triple_id", min_score, limit, scope, metric)


def search_entity_vector(triples, vectors, vector, min_score=0.7, limit=10, scope=Scope(), metric="l2") -> DataFrame:
    return nearest(triples, vectors, vector, "ENTITY", "knowledge_triple_id", min_score, limit, scope, metric)


def search_relationship_vector(triples, vectors, vector, min_score=0.7, limit=10, scope=Scope(), metric="l2") -> DataFrame:
    return nearest(triples, vectors, vector, "RELATIONSHIP", "knowledge_triple_id", min_score, limit, scope, metric)


def search_concept_vector(concepts, vectors, vector, min_score=0.7, limit=10, metric="l2") -> DataFrame:
    return nearest(concepts, vectors, vector, "CONCEPT", "concept_node_id", min_score, limit, metric=metric)


def concept_triples(triples: DataFrame, concepts: DataFrame, conceptualizations: DataFrame, vectors: DataFrame, vector: list[float],
                    min_score: float = 0.7, limit: int = 10, scope: Scope = Scope(), n_concepts: int | None = None) -> DataFrame:
    """Triples of the elements of the nearest concepts (``n_concepts``, else ``limit``), by (best concept's score, id)."""
    near = search_concept_vector(concepts, vectors, vector, min_score, n_concepts or limit).select("concept", F.col("score").alias("concept_score"))
    rel = conceptualizations.join(F.broadcast(near), "concept").groupBy("source_element").agg(F.max("concept_score").alias("concept_score"))  # near has `limit` rows
    found = triples_of_elements(scope.apply(triples), sent_if_few(rel))
    best = found.groupBy(*triples.columns).agg(F.max("concept_score").alias("concept_score"))
    return best.orderBy(F.desc("concept_score"), "id").limit(limit)


def search_with_fallback(triples: DataFrame, concepts: DataFrame, vectors: DataFrame, vector: list[float], min_score: float = 0.7, limit: int = 10, scope: Scope = Scope()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nearest triples, nearest concepts where no triple is near, the triples' source dates by month), with real scores.

    The second search depends on the first by a join with its count, so all is one plan.
    """
    hits = search_semantic(triples, vectors, vector, min_score, limit, scope)
    none = hits.agg(F.count(F.lit(1)).alias("n_hits"))  # one row
    near = search_concept_vector(concepts, vectors, vector, min_score, min(limit, 10))
    near = near.join(F.broadcast(none), F.col("n_hits") == 0).drop("n_hits")
    return hits, near, temporal_clusters(hits)
