"""Predicates shared by searches and scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space, window_bounds


@dataclass(frozen=True)
class TimeWindow:
    value: int
    unit: str
    start: str | None = None  # ISO, or None for now


@dataclass(frozen=True)
class Scope:
    """What a search looks at; ``types`` may be one value or several."""

    sources: Sequence[str] = ()
    types: Sequence[str] | str = ()
    source_types: Sequence[str] = ()
    date_from: str | None = None
    date_to: str | None = None
    window: TimeWindow | None = None
    extra: Sequence[Column] = field(default_factory=tuple)

    def conditions(self) -> list[Column]:
        types = [self.types] if isinstance(self.types, str) else list(self.types)
        out = [F.col(c).isin(list(v)) for c, v in (("source", self.sources), ("type", types), ("source_type", self.source_types)) if v]
        if self.window:
            start = F.lit(self.window.start).cast("timestamp") if self.window.start else F.current_timestamp()
            low, high = window_bounds(self.window.value, self.window.unit, start)
            out.append(F.col("source_date").between(low, high))
        else:
            if self.date_from:
                out.append(F.col("source_date") >= F.lit(self.date_from).cast("timestamp"))
            if self.date_to:
                out.append(F.col("source_date") <= F.lit(self.date_to).cast("timestamp"))
        return out + list(self.extra)

    def apply(self, df: DataFrame) -> DataFrame:
        tests = self.conditions()
        return df.filter(reduce(and_, tests)) if tests else df


def by_source_prefix(df: DataFrame, prefix: str, source_type: str | None = None) -> DataFrame:
    """Pushed down as a prefix test; ``src1`` also finds ``src10``."""
    out = df.filter(F.col("source").startswith(prefix))
    return out.filter(F.col("source_type") == source_type) if source_type else out


def by_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_semi")


def ids_exist(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """(id, found) for each of ``ids``."""
    asked = ids.select(column).distinct()
    # a hash of the asked ones in each task, past which the table's rows stream; they are neither sorted nor kept
    known = df.select(F.col(column).alias("known")).join(asked.toDF("asked").hint("shuffle_hash"), F.col("known") == F.col("asked"), "left_semi").distinct()
    return asked.join(known, F.col(column) == F.col("known"), "left").select(column, F.col("known").isNotNull().alias("found"))


def id_exists(df: DataFrame, one: str, column: str = "id") -> bool:
    """Stops at the first row that has it."""
    return not df.filter(F.col(column) == one).limit(1).isEmpty()


def of_concept(conceptualizations: DataFrame, concept: str) -> DataFrame:
    return conceptualizations.filter(F.col("concept") == concept)


def json_equals(column: str, path: str, value: str) -> Column:
    """Equality of a field within a JSON column, such as ``metadata`` and ``source_type``."""
    return F.get_json_object(column, f"$.{path}") == value


def vectors_of(vectors: DataFrame, triples: DataFrame, concepts: DataFrame) -> DataFrame:
    """Vectors of the given triples or concepts, each once: two semi joins, of which each drops what it doesn't look at first."""
    by_triple = vectors.filter("knowledge_triple_id is not null").join(triples.select(F.col("id").alias("knowledge_triple_id")), "knowledge_triple_id", "left_semi")
    rest = vectors.filter("concept_node_id is not null")
    by_concept = rest.join(concepts.select(F.col("id").alias("concept_node_id")), "concept_node_id", "left_semi")
    return by_triple.select(*vectors.columns).unionByName(by_concept.select(*vectors.columns)).dropDuplicates(["vector_id"])


def complete_triples(df: DataFrame) -> DataFrame:
    """Rows whose three parts are not blank."""
    return df.filter(reduce(and_, [F.length(trim_space(F.col(c))) > 0 for c in ("subject", "predicate", "object")]))


def valid_payload(items: Column) -> Column:
    """All items of an extraction payload are valid; one bad item rejects it."""
    ok = lambda t: (F.length(t["subject"]) > 0) & (F.length(t["predicate"]) > 0) & (F.length(t["object"]) > 0) & t["confidence"].between(0, 1)
    return F.forall(items, ok)


def usage_between(df: DataFrame, equals: dict[str, str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    for c, v in (equals or {}).items():
        df = df.filter(F.col(c) == v)
    if since:
        df = df.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until:
        df = df.filter(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    return df.orderBy(F.desc("timestamp"), "id")
