"""Queries over the demo graph, each with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures
from ..functions import text as T
from ..functions.chunking import chunk_column
from ..operators import concepts as C
from ..operators import dedup, entities, extract, filters, fusion, jobs, metric_join, report, search, store, text_index, usage, vector_index
from ..operators.filters import Scope, TimeWindow, by_ids, by_source_prefix, complete_triples, usage_between
from ..operators.numbering import numbered
from ..schema import JOB_STATUSES, TRIPLE_KEY, TRIPLE_TYPES
from ..streaming import job_stream
from ..streaming.job_state import Rules
from ..sources.tables import new_folder, once, requests, table, written
from .demo_graph import as_ctes, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, name: str | None = None, recursive: bool = False):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            head = as_ctes(*ctes).replace("with ", "with recursive ", 1) if recursive else as_ctes(*ctes)
            ORACLE[key] = f"{head} {sql}" if ctes else sql
        return f

    return add


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: the embedding of vec_id 0, one row."""
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


_ROW = "id, subject, predicate, object, type"
_COLUMNS = _ROW.split(", ")
_FIRST_VECTOR = "(select embedding from embeddings where vec_id = 0)"


@query(
    """, rows as (select subject entity, 'subject' role, source, type, extracted_at, confidence from triples
                  union all select object, 'object', source, type, extracted_at, confidence from triples)
    select entity, cast(count(*) as bigint) occurrences, string_agg(distinct role, ',' order by role) roles, cast(count(distinct source) as bigint) n_sources,
           string_agg(distinct type, ',' order by type) types, max(extracted_at) last_seen, cast(max(confidence) as double) best_confidence
    from rows group by entity having count(*) >= 5 order by occurrences desc, entity limit 50""",
    "triples",
)
def entity_enumeration(spark, d):
    return entities.enumerate_entities(load(spark, d, "triples"), min_occurrence=5, limit=50).withColumn("best_confidence", F.col("best_confidence").cast("double"))


@query(
    """select (select cast(count(*) as bigint) from triples) total_triples, (select cast(count(distinct type) as bigint) from triples) n_types,
              (select cast(count(distinct source) as bigint) from triples) n_sources, (select cast(count(*) as bigint) from concepts) total_concepts""",
    "triples", "concepts",
)
def graph_stats(spark, d):
    return entities.graph_stats(load(spark, d, "triples"), load(spark, d, "concepts"))


@query("select type, cast(count(*) as bigint) n from triples group by type", "triples")
def triples_by_type(spark, d):
    return entities.triples_by_type(load(spark, d, "triples"), TRIPLE_TYPES)


@query(f"select {_ROW} from triples where contains(lower(subject), 'asia') or contains(lower(predicate), 'asia') or contains(lower(object), 'asia') order by id limit 50", "triples")
def search_text(spark, d):
    return search.search_text(load(spark, d, "triples"), "Asia").select(*_COLUMNS)


@query(
    f"""select {_ROW} from triples where (contains(lower(subject), 'nation') or contains(lower(subject), 'customer:1') or contains(lower(object), 'nation') or contains(lower(object), 'customer:1'))
    and type in ('ENTITY_ENTITY', 'ENTITY_EVENT') order by subject desc, object desc, extracted_at desc, id limit 25""",
    "triples",
)
def search_entity(spark, d):
    return search.search_entity(load(spark, d, "triples"), "NATION customer:1", Scope(types=["ENTITY_ENTITY", "ENTITY_EVENT"]), 25).select(*_COLUMNS)


def _text_index(spark, d) -> text_index.TextIndex:
    def build(path: str) -> str:
        text_index.build(load(spark, d, "triples"), path)
        return path

    return text_index.TextIndex(spark, once(spark, f"{d}/text-index", build))


@query(f"select {_ROW} from triples where contains(lower(subject), 'asia') or contains(lower(predicate), 'asia') or contains(lower(object), 'asia') order by id limit 50", "triples")
def search_text_index(spark, d):
    """The same answer as search_text, from the rows whose texts hold the term's grams."""
    return search.search_text(_text_index(spark, d).candidates(["Asia"]), "Asia").select(*_COLUMNS)


@query(
    f"""select {_ROW} from triples where (contains(lower(subject), 'customer:77') or contains(lower(subject), 'order:12') or contains(lower(object), 'customer:77') or contains(lower(object), 'order:12'))
    order by subject desc, object desc, extracted_at desc, id limit 1000""",
    "triples",
)
def search_entity_index(spark, d):
    rows = _text_index(spark, d).candidates(T.search_terms("Customer:77 order:12"), ["subject", "object"])
    return search.search_entity(rows, "Customer:77 order:12", limit=1000).select(*_COLUMNS)


@query(f"select {_ROW} from triples where contains(lower(predicate), 'located') or contains(lower(predicate), 'feels') order by predicate desc, extracted_at desc, id limit 25", "triples")
def search_relationship(spark, d):
    return search.search_relationship(load(spark, d, "triples"), "located feels", limit=25).select(*_COLUMNS)


@query(
    """select distinct t.id, t.subject, t.predicate, t.object, t.type, t.extracted_at, cast(r.confidence as double) concept_confidence from triples t
    join conceptualizations r on (t.subject = r.source_element or t.object = r.source_element or t.predicate = r.source_element)
    where r.concept ilike '%topic 3%' order by concept_confidence desc nulls last, extracted_at desc, id limit 25""",
    "triples", "conceptualizations",
)
def search_concept_text(spark, d):
    out = search.search_concept_text(load(spark, d, "triples"), load(spark, d, "conceptualizations"), "topic 3", limit=25)
    return out.select(*_COLUMNS, "extracted_at", F.col("concept_confidence").cast("double").alias("concept_confidence"))


@query("select id, concept, abstraction_level from concepts where contains(lower(concept), 'topic') and abstraction_level = 'HIGH' order by id limit 50", "concepts")
def search_concepts(spark, d):
    return search.search_concepts(load(spark, d, "concepts"), "TOPIC", "high").select("id", "concept", "abstraction_level")


def _vector_query(kind: str) -> str:
    return f"""select distinct t.id, t.subject, t.object, round(1 - list_distance(cast(v.embedding as double[]), cast({_FIRST_VECTOR} as double[])), 6) score
    from triples t join vectors v on t.id = v.knowledge_triple_id where v.vector_type = '{kind}'
    and 1 - list_distance(cast(v.embedding as double[]), cast({_FIRST_VECTOR} as double[])) >= -0.45 order by score desc, t.id limit 20"""


def _vector_search(name: str, kind: str, f) -> None:
    @query(_vector_query(kind), "triples", "vectors", name=name)
    def run(spark, d):
        out = f(load(spark, d, "triples"), load(spark, d, "vectors"), _vector(spark, d), -0.45, 20)
        return out.select("id", "subject", "object", F.round("score", 6).alias("score"))


_vector_search("search_semantic", "SEMANTIC", search.search_semantic)
_vector_search("search_entity_vector", "ENTITY", search.search_entity_vector)
_vector_search("search_relationship_vector", "RELATIONSHIP", search.search_relationship_vector)


def _semantic_index(spark, d) -> vector_index.VectorIndex:
    def build(path: str) -> str:
        of = load(spark, d, "triples").select(F.col("id").alias("knowledge_triple_id"))
        vector_index.build(load(spark, d, "vectors").filter("vector_type = 'SEMANTIC'").join(of, "knowledge_triple_id", "left_semi"), path)  # vectors of stored triples
        return path

    return vector_index.VectorIndex(spark, once(spark, f"{d}/semantic-index", build))


@query(_vector_query("SEMANTIC"), "triples", "vectors")
def search_semantic_index(spark, d):
    """The same answer as without the index, from the cells that can hold it."""
    hits = _semantic_index(spark, d).search(_vector(spark, d), 20, -0.45).select(F.col("knowledge_triple_id").alias("id"), "score")
    found = load(spark, d, "triples").join(F.broadcast(hits), "id").select("id", "subject", "object", F.round("score", 6).alias("score"))  # hits has 20 rows
    return found.distinct().orderBy(F.desc("score"), "id").limit(20)


@query("select cast(count(*) as bigint) n_queries, cast(count(*) * 10 as bigint) wanted, true reached from embeddings where vec_id % 20 = 0")
def index_recall(spark, d):
    """Of an index of all embeddings, searched in half of its cells by every 20th vector against all: whether it finds at least 0.9 of the ten nearest."""

    def build(path: str) -> str:
        vector_index.build(table(spark, d, "embeddings"), path, key="vec_id")
        return path

    index = vector_index.VectorIndex(spark, once(spark, f"{d}/embeddings-index", build))
    asked = table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    said = index.recall(asked, 10, (len(index.cells) + 1) // 2)
    return said.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("wanted").alias("wanted"), (F.sum("found") >= 0.9 * F.sum("wanted")).alias("reached"))


@query(
    """select a.label, least(a.vec_id, b.vec_id) a, greatest(a.vec_id, b.vec_id) b from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id
    where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.3"""
)
def similar_vectors(spark, d):
    """Pairs of alike vectors within each label."""
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), "embedding")
    return metric_join.similar_pairs(rows, 0.3, "label").filter("a is not null").select("label", "a", "b")


@query(
    f"""select distinct c.id, c.concept, round(1 - list_distance(cast(v.embedding as double[]), cast({_FIRST_VECTOR} as double[])), 6) score
    from concepts c join vectors v on c.id = v.concept_node_id where v.vector_type = 'CONCEPT' order by score desc, c.id limit 15""",
    "concepts", "vectors",
)
def search_concept_vector(spark, d):
    out = search.search_concept_vector(load(spark, d, "concepts"), load(spark, d, "vectors"), _vector(spark, d), -9.0, 15)
    return out.select("id", "concept", F.round("score", 6).alias("score"))


_CONCEPT_LEG = f"""
, near as (select c.concept, 1 - list_distance(cast(v.embedding as double[]), cast({_FIRST_VECTOR} as double[])) score
  from concepts c join vectors v on c.id = v.concept_node_id where v.vector_type = 'CONCEPT' order by score desc, c.id limit 5),
best as (select r.source_element, max(n.score) score from conceptualizations r join near n on r.concept = n.concept group by 1),
concept_leg as (select t.{", t.".join(_COLUMNS)}, max(b.score) score from triples t join best b on t.subject = b.source_element or t.object = b.source_element or t.predicate = b.source_element
  group by all order by score desc, t.id limit 20)
"""


@query(f"{_CONCEPT_LEG} select {_ROW}, round(score, 6) concept_score from concept_leg", "triples", "concepts", "conceptualizations", "vectors")
def concept_to_triples(spark, d):
    triples, *rest = (load(spark, d, n) for n in ("triples", "concepts", "conceptualizations", "vectors"))
    found = search.concept_triples(triples.select(*_COLUMNS), *rest, _vector(spark, d), -9.0, 20, n_concepts=5)
    return found.withColumn("concept_score", F.round("concept_score", 6))


def _ranked(name: str, sql: str, order: str) -> str:
    key = ", ".join(TRIPLE_KEY)
    return f"{name} as (select {key}, row_number() over (order by {order}) - 1 pos, count(*) over () n from ({sql}))"


def _fusion_sql(w: dict[str, float]) -> str:
    legs = (("entity", "e"), ("relationship", "r"), ("semantic", "s"), ("concept", "c"))
    got = lambda x: f"({x}s is not null)::int"
    union = " union all ".join(f"select {_KEY}, '{leg}' leg, {i} i, pos, (n - pos) / n score from {x}" for i, (leg, x) in enumerate(legs))
    fused = " + ".join(f"coalesce({x}s * {w[leg]}, 0)" for leg, x in legs)
    weight, n = (" + ".join(f"{got(x)}{f' * {w[leg]}' if weighted else ''}" for leg, x in legs) for weighted in (True, False))
    return f"""{_CONCEPT_LEG},
{_ranked("e", "select * from triples where contains(lower(subject), 'customer:1') or contains(lower(object), 'customer:1') order by subject desc, object desc, extracted_at desc, id limit 20", "subject desc, object desc, extracted_at desc, id")},
{_ranked("r", "select * from triples where contains(lower(predicate), 'lives') order by predicate desc, extracted_at desc, id limit 20", "predicate desc, extracted_at desc, id")},
{_ranked("s", _vector_query("SEMANTIC").replace("select distinct t.id, t.subject, t.object,", "select distinct t.id, t.subject, t.predicate, t.object, t.type,"), "score desc, id")},
{_ranked("c", "select * from concept_leg", "score desc, id")},
legs as ({union}),
g as (select {_KEY}, {", ".join(f"min(score) filter (leg = '{leg}') {x}s" for leg, x in legs)}, min(i * 1000 + pos) f from legs group by all),
fused as (select {_KEY}, {", ".join(f"round({x}s, 6) {leg}_score" for leg, x in legs)}, cast({n} as int) n_legs,
  round(({fused}) / ({weight}) * (1 + 0.2 * ln(1 + {n}) / ln(5)), 6) fusion_score, f
from g order by fusion_score desc, f limit 10)
"""


_KEY = ", ".join(TRIPLE_KEY)
_GRAPH = ("triples", "concepts", "conceptualizations", "vectors")
_FUSED = f"{_KEY}, {', '.join(f'{k}_score' for k in fusion.LEGS)}, n_legs, fusion_score"


def _fused(spark, d, weights=None):
    """Each leg takes its top rows by what it needs alone: keys and orders."""
    triples, concepts, rel, vectors = (load(spark, d, n) for n in _GRAPH)
    triples, vector = triples.select(*_COLUMNS, "extracted_at"), _vector(spark, d)
    legs = [
        fusion.leg_scores(search.search_entity(triples, "customer:1", limit=20), "entity", [F.desc("subject"), F.desc("object"), F.desc("extracted_at"), "id"]),
        fusion.leg_scores(search.search_relationship(triples, "lives", limit=20), "relationship", [F.desc("predicate"), F.desc("extracted_at"), "id"]),
        fusion.leg_scores(search.search_semantic(triples, vectors, vector, -0.45, 20), "semantic", [F.desc(F.round("score", 6)), "id"]),
        fusion.leg_scores(concept_to_triples(spark, d), "concept", [F.desc("concept_score"), "id"]),
    ]
    out = fusion.fuse(legs, weights)
    return out.select(*TRIPLE_KEY, *[F.round(f"{k}_score", 6).alias(f"{k}_score") for k in fusion.LEGS], "n_legs", F.round("fusion_score", 6).alias("fusion_score"))


@query(f"{_fusion_sql(fusion.WEIGHTS)} select {_FUSED} from fused", *_GRAPH)
def fusion_search(spark, d):
    return _fused(spark, d)


@query(f"{_fusion_sql(fusion.TEXT_WEIGHTS)} select {_FUSED} from fused", *_GRAPH)
def graph_search_text(spark, d):
    return _fused(spark, d, fusion.TEXT_WEIGHTS)


@query(
    f"{_fusion_sql(fusion.TEXT_WEIGHTS)} select strftime(source_date, '%Y-%m') period, cast(count(*) as bigint) n, min(source_date) first_date, max(source_date) last_date "
    "from triples join fused using (subject, predicate, object, type) where source_date is not null group by 1",
    *_GRAPH,
)
def graph_search_months(spark, d):
    hits = graph_search_text(spark, d).select(*TRIPLE_KEY)
    return entities.temporal_clusters(load(spark, d, "triples").join(F.broadcast(hits), TRIPLE_KEY, "left_semi"))  # hits has 10 rows


def _fallback_sql(least: float) -> str:
    near = f"1 - list_distance(cast(v.embedding as double[]), cast({_FIRST_VECTOR} as double[]))"
    return f""", hits as (select distinct t.id, t.subject name, {near} score from triples t join vectors v on t.id = v.knowledge_triple_id
      where v.vector_type = 'SEMANTIC' and {near} >= {least} order by score desc, t.id limit 10),
    near as (select distinct c.id, c.concept name, {near} score from concepts c join vectors v on c.id = v.concept_node_id where v.vector_type = 'CONCEPT' and {near} >= {least} order by score desc, c.id limit 10)
    select 'triple' found, id, name, round(score, 6) score from hits union all select 'concept', id, name, round(score, 6) from near where not exists (select 1 from hits)"""


def _fallback(spark, d, least):
    hits, near, _ = search.search_with_fallback(*(load(spark, d, n) for n in ("triples", "concepts", "vectors")), _vector(spark, d), least, 10)
    named = lambda df, kind, name: df.select(F.lit(kind).alias("found"), "id", F.col(name).alias("name"), F.round("score", 6).alias("score"))
    return named(hits, "triple", "subject").unionByName(named(near, "concept", "concept"))


@query(_fallback_sql(-0.45), "triples", "concepts", "vectors")
def graph_search_vector(spark, d):
    """Some triple is near, so no concept is asked for."""
    return _fallback(spark, d, -0.45)


@query(_fallback_sql(0.0), "triples", "concepts", "vectors")
def graph_search_vector_fallback(spark, d):
    """Where no triple is as near, concepts are, among them the query's own vector."""
    return _fallback(spark, d, 0.0)


@query(f"select {_KEY}, min(id) id, cast(max(confidence) as double) confidence, max(extracted_at) extracted_at, cast(count(*) as bigint) n_merged from triples group by {_KEY}", "triples")
def exact_dedup(spark, d):
    return dedup.exact_dedup(load(spark, d, "triples")).select(*TRIPLE_KEY, "id", F.col("confidence").cast("double").alias("confidence"), "extracted_at", "n_merged")


@query(f"select id, m merged_into from (select id, min(id) over (partition by {_KEY}) m from triples) x where id <> m", "triples")
def dedup_metadata(spark, d):
    return dedup.dedup_metadata(load(spark, d, "triples"))


def told_vectors(spark, d):
    """(text, embedding) of the triples "customer:N lives in ...", by the N-th embedding."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("customer:"), "vec_id").alias("subject"), "embedding")
    told = load(spark, d, "triples").filter("predicate = 'lives in'").select("subject", F.concat_ws(" ", "subject", "predicate", "object").alias("text"))
    return told.join(e, "subject").select("text", "embedding")


_GREEDY = f"""
, told as (select {_KEY}, e.embedding from triples t join embeddings e on t.subject = 'customer:' || cast(e.vec_id as varchar(20)) where t.predicate = 'lives in'),
x as materialized (select {_KEY}, arg_min(id, id) id, arg_min(source, id) source, max(confidence) confidence, max(extracted_at) extracted_at, cast(count(*) as bigint) n from triples group by {_KEY}),
r as materialized (select x.*, regexp_replace(x.source, '_chunk_[0-9]+$', '') root, cast(e.embedding as double[]) e, row_number() over (partition by regexp_replace(x.source, '_chunk_[0-9]+$', '') order by x.id) i
  from x join (select distinct subject || ' ' || predicate || ' ' || object t, embedding from told) e on e.t = x.subject || ' ' || x.predicate || ' ' || x.object),
g as (select root, cast(0 as bigint) i, cast(null as bigint) leader, cast([] as struct(i bigint, e double[])[]) heads from (select distinct root from r) q
  union all
  select g.root, r.i, coalesce(h.found[1].i, r.i), case when len(h.found) = 0 then list_append(g.heads, {{'i': r.i, 'e': r.e}}) else g.heads end
  from g join r on r.root = g.root and r.i = g.i + 1, lateral (select list_filter(g.heads, lambda l: list_cosine_similarity(l.e, r.e) >= 0.3) found) h),
m as (select g.root, g.leader i, max(r.confidence) confidence, max(r.extracted_at) extracted_at, cast(sum(r.n) as bigint) n_rows, cast(count(*) as bigint) n_keys from g join r on g.root = r.root and g.i = r.i group by all)
select r.id, {", ".join(f"r.{c}" for c in TRIPLE_KEY)}, cast(m.confidence as double) confidence, m.extracted_at, m.n_keys + r.n - 1 n_merged from m join r on m.root = r.root and m.i = r.i
union all
select x.id, {", ".join(f"x.{c}" for c in TRIPLE_KEY)}, cast(x.confidence as double), x.extracted_at, x.n from x where not exists (select 1 from r where r.id = x.id)
"""


@query(_GREEDY, "triples", recursive=True)
def semantic_dedup(spark, d):
    """Survivors of exact and semantic dedup within each source, over all triples; those without a vector stay."""
    triples = load(spark, d, "triples").withColumn("source_root", F.regexp_replace("source", "_chunk_[0-9]+$", ""))
    out = dedup.deduplicated(triples, told_vectors(spark, d), 0.3, stage=lambda df: written(df, new_folder(spark, "semantic-dedup")))
    return out.select("id", *TRIPLE_KEY, F.col("confidence").cast("double").alias("confidence"), "extracted_at", "n_merged")


@query(f"select t.id from triples t join (select {_KEY}, min(id) m from triples group by {_KEY}) k using ({_KEY}) where t.id = k.m", "triples")
def delete_duplicates(spark, d):
    triples = load(spark, d, "triples")
    gone = dedup.dropped_rows(triples).drop("merged_into")
    return store.delete_triples(triples, load(spark, d, "vectors"), gone)[0].select("id")


def _by_length(texts: list[str]):
    """Vectors alike if the texts' lengths are, modulo 7: what SQL can follow."""
    import numpy as np

    return np.eye(64)[[len(t) % 7 for t in texts]]


@query(
    f""", x as (select *, regexp_replace(source, '_chunk_[0-9]+$', '') root, length(subject || ' ' || predicate || ' ' || object) % 7 l from (
      select {_KEY}, min(id) id, arg_min(source, id) source, arg_min(source_type, id) source_type, max(confidence) confidence, max(extracted_at) extracted_at from triples group by {_KEY}) k),
    m as (select root, source_type, min(id) id, max(confidence) confidence, max(extracted_at) extracted_at from x group by root, source_type, l)
    select x.subject, x.predicate, x.object, x.type, x.source, cast(m.confidence as double) confidence, m.extracted_at from m join x on m.id = x.id""",
    "triples",
)
def dedup_job(spark, d):
    """Published triples after a dedup job of all sources: survivors with what was merged into them."""
    from ..graph import KnowledgeGraph

    graph = KnowledgeGraph(spark, new_folder(spark, "graph"), embedder=_by_length, semantic_dedup=0.9)
    graph.publish_rows("triples", dedup.exact_dedup(load(spark, d, "triples")).drop("n_merged"))
    graph.dedup_job(graph.table("triples").select(F.regexp_replace("source", "_chunk_[0-9]+$", "").alias("source"), "source_type").distinct(), "2025-01-01 00:00:00")
    return graph.table("triples").select(*TRIPLE_KEY, "source", F.col("confidence").cast("double").alias("confidence"), "extracted_at")


@query(
    """, links as (select distinct t.subject source_element, c.concept, t.source, t.source_type from triples t join conceptualizations c on t.subject = c.source_element),
    els as (select distinct source_element, source, source_type from links),
    hits as (select distinct e.*, t.id from els e join triples t on t.source = e.source and t.source_type = e.source_type and (t.subject = e.source_element or t.object = e.source_element or t.predicate = e.source_element)),
    ranked as (select *, row_number() over (partition by source_element, source, source_type order by id) n from hits)
    select l.source_element, l.concept, l.source, l.source_type, r.id, cast(r.n as int) place from links l join ranked r using (source_element, source, source_type) where r.n <= 5""",
    "triples", "conceptualizations",
)
def concept_contexts(spark, d):
    """The first five triples of each relationship's element within the relationship's own source."""
    triples, rel = load(spark, d, "triples"), load(spark, d, "conceptualizations").select("source_element", "concept").distinct()
    links = triples.join(rel, F.col("subject") == F.col("source_element")).select("source_element", "concept", "source", "source_type").distinct()
    return C.context_triples(triples, links, 5, ["source", "source_type"]).withColumnRenamed("rank", "place")


@query(
    """select vec_id, case when vec_id % 3 = 0 then label + 100 else label end label from embeddings where vec_id % 5 <> 1 or vec_id % 3 = 0
    union all select vec_id + 1000000000, label from embeddings where vec_id % 7 = 0"""
)
def store_changes(spark, d):
    """A table after deletes, an upsert and an append, as its folders and delete folders give it."""
    schemas = {"t": "vec_id bigint, label int"}
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    s = store.Store(spark, new_folder(spark, "store"))
    s.publish({"t": rows}, None, schemas)
    s.publish({"t": rows.filter("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1000000000)}, None, schemas, deleted={"t": rows.filter("vec_id % 5 = 1").select("vec_id")})
    s.upsert("t", rows.filter("vec_id % 3 = 0").withColumn("label", (F.col("label") + 100).cast("int")), ["vec_id"], schemas)
    return s.read("t", schemas["t"])


@query(
    """with e as (select doc_id, case when doc_id % 7 = 0 then 'FAILED' else 'COMPLETED' end s, case when doc_id % 7 = 0 then 2 when doc_id % 5 = 0 then 1 else 0 end n from documents)
    select 'job-' || cast(doc_id as varchar(20)) id, s status, cast(0 as int) retry_count from e union all select 'job-' || cast(doc_id as varchar(20)) || '-extraction', s, cast(n as int) from e
    union all select 'job-' || cast(doc_id as varchar(20)) || f, 'COMPLETED', cast(0 as int) from e, (select '-concepts' f union all select '-deduplication') x where s = 'COMPLETED'"""
)
def job_stream_states(spark, d):
    """What a stream brings all documents' pipelines to: every fifth extraction is tried twice, every seventh fails, the others are followed by both stages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.lit("file").alias("source_type"))
    asked = jobs.pipeline_events(docs.withColumn("text", F.lit(None).cast("string")), "2025-01-01 00:00:00", False).filter("stage is null or stage = 'EXTRACTION'")
    asked = asked.withColumns({"event_time": F.lit("2025-01-01").cast("timestamp"), "retry_count": F.lit(0), "max_retries": F.lit(2)})
    n = F.split("id", "-")[1].cast("long")
    fails = (n % 7 == 0) | ((n % 5 == 0) & (F.col("retry_count") < 1))
    done = {"status": F.lit("COMPLETED"), "progress": F.lit(100)}
    handlers = {
        "EXTRACT_KNOWLEDGE_BATCH": lambda batch: batch.withColumns({"status": F.when(fails, "FAILED").otherwise("COMPLETED"), "progress": F.lit(100)}),
        "GENERATE_CONCEPTS": lambda batch: batch.withColumns(done), "DEDUPLICATE_KNOWLEDGE": lambda batch: batch.withColumns(done),
    }
    where, out = new_folder(spark, "job-events"), new_folder(spark, "job-states")
    job_stream.enqueue(spark, where, asked)
    stream = job_stream.run_jobs(spark, where, out, new_folder(spark, "job-stream"), handlers, Rules(second=0, backoff=0), every="0 seconds")
    total = docs.select(F.count(F.lit(1)) * 2 + 2 * F.count_if(F.col("id").cast("long") % 7 != 0)).first()[0]
    job_stream.wait_until_final(stream, spark, out, total, 3600)
    return job_stream.job_states(spark, out, "status", "retry_count")


_DICTIONARY = """dictionary as (select 'customer:' || cast(vec_id as varchar(20)) text, cast(vec_id as bigint) n from embeddings
  union all select distinct predicate, cast(-1 as bigint) from triples where predicate <> 'performed'
  union all select distinct subject || ' ' || predicate || ' ' || object, cast(-2 as bigint) from triples where type = 'EMOTIONAL_CONTEXT')"""
_TEXTS = """texts as (select distinct id, vector_type, text from (select id, 'ENTITY' vector_type, subject text from triples union all select id, 'ENTITY', object from triples
  union all select id, 'RELATIONSHIP', predicate from triples union all select id, 'SEMANTIC', subject || ' ' || predicate || ' ' || object from triples) x)"""


def _dictionary(spark, d):
    triples = load(spark, d, "triples")
    entities_ = table(spark, d, "embeddings").select(F.concat(F.lit("customer:"), "vec_id").alias("text"), F.col("vec_id").cast("long").alias("n"))
    predicates = triples.filter("predicate <> 'performed'").select(F.col("predicate").alias("text")).distinct().withColumn("n", F.lit(-1).cast("long"))
    told = triples.filter("type = 'EMOTIONAL_CONTEXT'").select(F.concat_ws(" ", "subject", "predicate", "object").alias("text")).distinct().withColumn("n", F.lit(-2).cast("long"))
    return entities_.unionByName(predicates).unionByName(told)


@query(
    f""", {_DICTIONARY}, {_TEXTS}
    select replace(replace(replace(base64(encode(t.id || '|' || t.vector_type || '|' || t.text)), '+', '_'), '/', '_'), '=', '_') vector_id, t.text, t.vector_type,
    case when t.vector_type = 'ENTITY' then t.text end entity_name, t.id knowledge_triple_id, d.n from texts t join dictionary d on t.text = d.text""",
    "triples",
)
def vector_materialise(spark, d):
    """Entity, relationship and semantic vectors of what a dictionary knows."""
    dictionary = _dictionary(spark, d).withColumnRenamed("n", "embedding")
    out = store.vector_rows(store.known_texts(load(spark, d, "triples"), dictionary).distinct())  # which the ids follow from
    return out.select("vector_id", "text", "vector_type", "entity_name", "knowledge_triple_id", F.col("embedding").alias("n"))


@query(
    f""", {_DICTIONARY}, {_TEXTS} select vector_type, cast(count(*) as bigint) misses from (select distinct vector_type, text from texts where text not in (select text from dictionary)) m group by 1""",
    "triples",
)
def missing_vectors(spark, d):
    return store.missing_texts(load(spark, d, "triples"), _dictionary(spark, d)).groupBy("vector_type").agg(F.count(F.lit(1)).alias("misses"))


@query(
    """, texts as (select subject t from triples union all select predicate from triples union all select object from triples
      union all select subject || ' ' || predicate || ' ' || object from triples union all select concept from concepts)
    select cast(count(*) as bigint) total_texts, cast(count(distinct t) as bigint) unique_texts, cast(count(*) - count(distinct t) as bigint) duplicates_averted,
    cast(ceil(count(distinct t) / 100.0) as bigint) batch_calls from texts""",
    "triples", "concepts",
)
def embedding_map_stats(spark, d):
    return entities.embedding_map_stats(load(spark, d, "triples"), load(spark, d, "concepts"))


@query(
    """select distinct kind, text from (
      select case when type in ('ENTITY_ENTITY', 'ENTITY_EVENT') then 'entity' else 'event' end kind, subject text from triples
      union all select case when type = 'ENTITY_ENTITY' then 'entity' else 'event' end, object from triples
      union all select 'relationship', predicate from triples) x""",
    "triples",
)
def element_extraction(spark, d):
    return C.element_sets(load(spark, d, "triples"))


@query(
    "select strftime(source_date, '%Y-%m') period, cast(count(*) as bigint) n, min(source_date) first_date, max(source_date) last_date from triples where source_date is not null group by 1",
    "triples",
)
def temporal_clusters(spark, d):
    return entities.temporal_clusters(load(spark, d, "triples"))


@query(f"select {_ROW}, source_date from triples where source_date between timestamp '1997-04-01 00:00:00' - interval '2' month and timestamp '1997-04-01 00:00:00' and source_type in ('file', 'api')", "triples")
def temporal_filter(spark, d):
    scope = Scope(window=TimeWindow(2, "months", "1997-04-01 00:00:00"), source_types=["file", "api"])
    return scope.apply(load(spark, d, "triples")).select(*_COLUMNS, "source_date")


@query(f"select {_ROW}, source from triples where starts_with(source, 'src1') and source_type = 'file'", "triples")
def source_prefix(spark, d):
    return by_source_prefix(load(spark, d, "triples"), "src1", "file").select(*_COLUMNS, "source")


_SUMS = "cast(count(*) as bigint) calls, cast(sum(input_tokens) as bigint) input_tokens, cast(sum(output_tokens) as bigint) output_tokens, cast(sum(total_tokens) as bigint) total_tokens, cast(sum(duration_ms) as bigint) duration_ms"


@query(
    f"""select 'total' as "level", null operation_type, null provider, {_SUMS} from token_usage union all select 'operation', operation_type, null, {_SUMS} from token_usage group by operation_type
    union all select 'provider', null, provider, {_SUMS} from token_usage group by provider""",
    "token_usage",
)
def token_usage_summary(spark, d):
    return usage.usage_summary(load(spark, d, "token_usage"))


@query(
    """select u.id, u.model, round(u.input_tokens / 1000 * price_in + u.output_tokens / 1000 * price_out
      + case when coalesce(thinking_tokens, 0) <> 0 and coalesce(reasoning_tokens, 0) <> 0 then thinking_tokens / 1000 * price_thinking + reasoning_tokens / 1000 * price_reasoning else 0 end, 6) cost
    from token_usage u left join prices p on p.price_model = split_part(u.model, '/', -1)""",
    "token_usage", "prices",
)
def token_cost(spark, d):
    prices = load(spark, d, "prices").select("price_model", *[F.col(c).cast("double").alias(c) for c in ("price_in", "price_out", "price_thinking", "price_reasoning")])
    return usage.usage_costs(load(spark, d, "token_usage"), prices).select("id", "model", F.round("cost", 6).alias("cost"))


@query(
    """select id, operation_type from token_usage where provider = 'openai' and "timestamp" >= timestamp '2024-01-01 00:00:00' order by "timestamp" desc, id""",
    "token_usage",
)
def usage_filter(spark, d):
    return usage_between(load(spark, d, "token_usage"), {"provider": "openai"}, "2024-01-01 00:00:00").select("id", "operation_type")


@query(
    r"""select doc_id, substring(trim(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(65279)), 1, 2000) text,
    round(greatest(0, least(1, (n_chars % 300) / 100.0 - 1)), 6) confidence from documents"""
)
def sanitize_clamp(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.sanitize(F.col("text"), 2000).alias("text"), F.round(T.clamp_confidence((F.col("n_chars") % 300) / 100.0 - 1), 6).alias("confidence"))


@query("select id, replace(replace(replace(base64(encode(subject || '|' || predicate || '|' || object || '|' || type)), '+', '_'), '/', '_'), '=', '_') triple_id from triples", "triples")
def triple_ids(spark, d):
    return load(spark, d, "triples").select("id", T.safe_id(*[F.col(c) for c in TRIPLE_KEY]).alias("triple_id"))


def _masked(c: str) -> str:
    out = f"case when length({c}) > 200 then substring({c}, 1, 200) || '...' else {c} end"
    for pattern, tag in T.MASKS:
        out = f"regexp_replace({out}, '{pattern}', '{tag}', 'g')"
    return out


@query(f"select doc_id, {_masked('text')} masked from documents")
def mask_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", T.mask(F.col("text")).alias("masked"))


@query(
    """, els as (select distinct source_element, concept from conceptualizations),
    hits as (select distinct e.source_element, t.id from (select distinct source_element from els) e join triples t on t.subject = e.source_element or t.object = e.source_element or t.predicate = e.source_element),
    ranked as (select *, row_number() over (partition by source_element order by id) as "rank" from hits)
    select e.source_element, e.concept, r.id, cast(r."rank" as int) as "rank" from els e join ranked r on e.source_element = r.source_element where r."rank" <= 5""",
    "triples", "conceptualizations",
)
def context_top5(spark, d):
    return C.context_triples(load(spark, d, "triples"), load(spark, d, "conceptualizations"))


@query(f"select {_ROW} from triples t where exists (select 1 from conceptualizations c where c.concept = 'Topic 2' and c.source_element in (t.subject, t.predicate, t.object))", "triples", "conceptualizations")
def concept_semi_join(spark, d):
    return C.triples_of_concept(load(spark, d, "triples"), load(spark, d, "conceptualizations"), "Topic 2").select(*_COLUMNS)


@query(
    """select 'v' || cast(vec_id as varchar(20)) vector_id, case when vec_id % 2 = 0 then label + 100 else label end version from embeddings
    union all select 'new' || cast(vec_id as varchar(20)), label from embeddings where vec_id % 7 = 0"""
)
def upsert_vectors(spark, d):
    e = table(spark, d, "embeddings")
    stored = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("vector_id"), F.col("label").alias("version"))
    changed = e.filter("vec_id % 2 = 0").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("vector_id"), (F.col("label") + 100).alias("version"))
    added = e.filter("vec_id % 7 = 0").select(F.concat(F.lit("new"), F.col("vec_id").cast("string")).alias("vector_id"), F.col("label").alias("version"))
    return store.upsert(stored, changed.unionByName(added), "vector_id", "version")


@query(f"select distinct {_KEY} from triples x where not exists (select 1 from triples s where s.source_type = 'file' and s.subject = x.subject and s.predicate = x.predicate and s.object = x.object and s.type = x.type)", "triples")
def anti_join_new(spark, d):
    t = load(spark, d, "triples")
    return store.new_rows(t, t.filter("source_type = 'file'"), TRIPLE_KEY).select(*TRIPLE_KEY)


_KNOWN = "source_type = 'file'"
_GONE = "(type = 'ENTITY_EVENT' and predicate = 'placed')"


def _grown(spark: SparkSession, d: str) -> tuple[store.Store, dict[str, str]]:
    """A store of the triples in two publications, the second of which deletes the first one's orders; made once in a session."""

    def build(root: str) -> tuple[str, dict[str, str]]:
        t, c = load(spark, d, "triples"), load(spark, d, "concepts")
        schemas = {"triples": _ddl(t), "concepts": _ddl(c)}
        s = store.Store(spark, root, _UNIQUE, _COUNTED)
        s.publish({"triples": t.filter(f"{_KNOWN} or {_GONE}"), "concepts": c}, None, schemas)
        s.publish({"triples": t.filter(f"not ({_KNOWN} or {_GONE})")}, None, schemas, deleted={"triples": t.filter(_GONE).select(*TRIPLE_KEY)})
        return root, schemas

    root, schemas = once(spark, f"{d}/grown", build)
    return store.Store(spark, root, _UNIQUE, _COUNTED), schemas


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


_UNIQUE = {"triples": TRIPLE_KEY}
_COUNTED = {"triples": {"entities": entities.entity_counts, "kinds": entities.kind_counts}, "concepts": {"levels": entities.level_counts}}


@query(f"select distinct {_KEY} from triples where (type = 'ENTITY_EVENT' and predicate = 'placed')", "triples")
def insert_ignore_filtered(spark, d):
    """What of all triples a store doesn't hold, of which it has deleted the orders; folders that can't hold a key are not read."""
    s, schemas = _grown(spark, d)
    return s.new_rows("triples", load(spark, d, "triples"), schemas["triples"]).select(*TRIPLE_KEY)


@query(
    """, left_ as (select * from triples where not (type = 'ENTITY_EVENT' and predicate = 'placed'))
    select (select cast(count(*) as bigint) from left_) total_triples, (select cast(count(distinct type) as bigint) from left_) n_types,
           (select cast(count(distinct source) as bigint) from left_) n_sources, (select cast(count(*) as bigint) from concepts) total_concepts""",
    "triples", "concepts",
)
def graph_stats_incremental(spark, d):
    """Statistics from the publications' counts, those of deleted rows among them."""
    s, schemas = _grown(spark, d)
    return entities.stats_counted(s.view("triples", "kinds", schemas["triples"]), s.view("concepts", "levels", schemas["concepts"]))


@query(
    """, left_ as (select * from triples where not (type = 'ENTITY_EVENT' and predicate = 'placed')),
    rows as (select subject entity, 'subject' role, source, type, extracted_at, confidence from left_ union all select object, 'object', source, type, extracted_at, confidence from left_)
    select entity, cast(count(*) as bigint) occurrences, string_agg(distinct role, ',' order by role) roles, cast(count(distinct source) as bigint) n_sources,
           string_agg(distinct type, ',' order by type) types, max(extracted_at) last_seen, cast(max(confidence) as double) best_confidence from rows group by entity""",
    "triples",
)
def entities_incremental(spark, d):
    """All entities from the publications' counts, those of deleted rows among them."""
    s, schemas = _grown(spark, d)
    return entities.enumerate_counted(s.view("triples", "entities", schemas["triples"], by=entities.COUNTED_BY)).withColumn("best_confidence", F.col("best_confidence").cast("double"))


@query("select id from triples where id in (select 'ENTITY_EVENT:placed:' || cast(o_orderkey as varchar(20)) from orders where o_orderpriority = '1-URGENT')", "triples")
def existing_ids(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("ENTITY_EVENT:placed:"), F.col("o_orderkey").cast("string")).alias("id"))
    return store.existing_ids(load(spark, d, "triples"), ids)


@query("select " + ", ".join(f"cast(count(*) filter (status = '{s}') as bigint) {s.lower()}" for s in JOB_STATUSES) + " from jobs", "jobs")
def queue_stats(spark, d):
    return jobs.queue_stats(load(spark, d, "jobs"))


@query("select parent_job_id parent, stage, status, progress from (select *, row_number() over (partition by parent_job_id, stage order by created_at desc, id desc) n from jobs where parent_job_id is not null) x where n = 1", "jobs")
def pipeline_status(spark, d):
    j = load(spark, d, "jobs").withColumns({"started_at": F.lit(None).cast("timestamp"), "completed_at": F.lit(None).cast("timestamp")})
    return jobs.pipeline_status(j).select("parent", "stage", "status", "progress")


@query(
    """, c as (select parent_job_id p, bool_and(status in ('COMPLETED', 'FAILED')) done, bool_or(status = 'FAILED') failed from jobs where parent_job_id is not null group by 1)
    select j.id parent, coalesce(c.done, true) complete, case when not coalesce(c.done, true) then 'PROCESSING' when c.failed then 'FAILED' else 'COMPLETED' end status
    from jobs j left join c on j.id = c.p where j.parent_job_id is null""",
    "jobs",
)
def pipeline_complete(spark, d):
    return jobs.pipeline_complete(load(spark, d, "jobs"))


@query("select id, stage, retry_count from jobs where status = 'FAILED' and retry_count < max_retries", "jobs")
def retry_eligible(spark, d):
    return jobs.retry_eligible(load(spark, d, "jobs")).select("id", "stage", "retry_count")


@query("select id, stage, created_at from jobs where status = 'QUEUED' order by created_at, id limit 20", "jobs")
def next_queued(spark, d):
    return jobs.next_queued(load(spark, d, "jobs"), 20).select("id", "stage", "created_at")


@query(
    """, b as (select id, cast(least(60, greatest(6, ceil(duration_ms / 1000.0), ceil(total_tokens / 10.0))) as bigint) delay from token_usage)
    select id, delay, cast(greatest(6, delay * 0.1) as double) concepts, cast(greatest(10, delay * 0.2) as double) deduplication from b""",
    "token_usage",
)
def processing_delay(spark, d):
    base = load(spark, d, "token_usage").select("id", measures.processing_delay(F.col("duration_ms"), F.col("total_tokens")).alias("delay"))
    return base.select("id", "delay", *[measures.stage_delay(F.lit(s), F.col("delay")).alias(s.lower()) for s in ("CONCEPTS", "DEDUPLICATION")])


@query(
    """select operation_type, cast(count(*) as bigint) calls, round(avg(duration_ms), 4) mean_ms, round(stddev_samp(duration_ms), 4) deviation_ms,
    round(cast(max(duration_ms) as double) / min(duration_ms), 4) spread, round(cast(count(*) filter (ok) as double) / count(*), 6) success_rate from token_usage group by 1""",
    "token_usage",
)
def latency_stats(spark, d):
    out = usage.latency_stats(load(spark, d, "token_usage"), "operation_type")
    return out.select("operation_type", "calls", *[F.round(c, 4).alias(c) for c in ("mean_ms", "deviation_ms", "spread")], F.round("success_rate", 6).alias("success_rate"))


@query(
    """, m as (select model, avg(duration_ms) mean_ms, sum(total_tokens) * 1000.0 / sum(duration_ms) tps from token_usage group by 1)
    select model, round(mean_ms, 4) mean_ms, round(cast(tps as double), 4) tokens_per_second, cast(row_number() over (order by mean_ms, model) as int) place,
    case when mean_ms > 3000 then 'HIGH' when mean_ms > 1500 then 'MEDIUM' else 'LOW' end latency from m""",
    "token_usage",
)
def batch_ranking(spark, d):
    out = usage.ranking(load(spark, d, "token_usage"), "model")
    return out.select("model", F.round("mean_ms", 4).alias("mean_ms"), F.round("tokens_per_second", 4).alias("tokens_per_second"), "place", "latency")


@query("select arg_min(id, duration_ms * 1000000000 + id) fastest, arg_max(id, duration_ms * 1000000000 + id) slowest from token_usage", "token_usage")
def fastest_slowest(spark, d):
    return usage.extremes(load(spark, d, "token_usage"), "id")


@query(f"select {_ROW} from triples where length(id) % 3 <> 0 and length(id) % 5 <> 0", "triples")
def complete_rows(spark, d):
    """Of triples, some of which have lost a part or have a blank one, those with all three."""
    n = F.length("id")
    rows = load(spark, d, "triples").withColumns({
        "subject": F.when(n % 3 == 0, F.lit(" \t")).otherwise(F.col("subject")), "object": F.when(n % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("object")),
    })
    return complete_triples(rows).select(*_COLUMNS)


@query("select date_trunc('hour', \"timestamp\") window_start, operation_type, cast(sum(total_tokens) as bigint) tokens, cast(count(*) as bigint) calls from token_usage group by 1, 2", "token_usage")
def usage_windows(spark, d):
    from ..streaming.job_stream import usage_windows as windows

    return windows(load(spark, d, "token_usage")).select(F.col("window.start").alias("window_start"), "operation_type", "tokens", "calls")


@query("select doc_id, cast(ceil(length(text) / 4.0) as bigint) estimate, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) n_terms from documents")
def text_measures(spark, d):
    terms = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"), F.size(terms).cast("long").alias("n_terms"))


@query()
def chunk_documents(spark, d):
    """Chunks of long texts; a stateful fold, which tests compare by its limits, overlaps and coverage."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(chunk_column(F.col("text"), 500, 50)).alias("i", "c"))
    return docs.select("doc_id", "i", F.col("c.text").alias("text"), F.col("c.estimated_tokens").alias("estimated_tokens"), F.col("c.start").alias("start"), F.col("c.end").alias("end"))


@query()
def extract_triples(spark, d):
    """By the local rules, which tests compare with sentences worked by hand."""
    docs = table(spark, d, "documents").select("text", "source", F.lit("file").alias("source_type"))
    return extract.extract_triples(docs, TRIPLE_TYPES).select(*TRIPLE_KEY, "source", F.round("confidence", 2).alias("confidence"), "error")


@query()
def chunk_counts(spark, d):
    """Chunks by document, as extraction counts them; chunking is a fold, so tests compare it with golden chunks."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source", F.lit("file").alias("source_type"))
    return extract.chunk_counts(extract.extraction_rows(docs, TRIPLE_TYPES, max_tokens=500), "doc")


# -- lookups

_URGENT = "select 'ENTITY_EVENT:placed:' || cast(o_orderkey as varchar(20)) id from orders where o_orderpriority = '1-URGENT'"


def _urgent(spark, d):
    return table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("ENTITY_EVENT:placed:"), "o_orderkey").alias("id"))


@query(f"select {_ROW} from triples where id in ({_URGENT})", "triples")
def triples_by_ids(spark, d):
    return by_ids(load(spark, d, "triples"), _urgent(spark, d)).select(*_COLUMNS)


@query("select id, concept from concepts where id in (select 'c' || cast(n_nationkey as varchar(20)) from nation)", "concepts")
def concepts_by_ids(spark, d):
    ids = table(spark, d, "nation").select(F.concat(F.lit("c"), "n_nationkey").alias("id"))
    return by_ids(load(spark, d, "concepts"), ids).select("id", "concept")


@query(
    f"select i.id, i.id in (select id from triples) found from (select distinct id from ({_URGENT} union all select 'no:' || cast(n_nationkey as varchar(20)) from nation) x) i",
    "triples",
)
def ids_exist(spark, d):
    other = table(spark, d, "nation").select(F.concat(F.lit("no:"), "n_nationkey").alias("id"))
    return filters.ids_exist(load(spark, d, "triples"), _urgent(spark, d).unionByName(other))


@query("select source_element, cast(confidence as double) confidence from conceptualizations where concept = 'Topic 4'", "conceptualizations")
def concept_lookup(spark, d):
    return filters.of_concept(load(spark, d, "conceptualizations"), "Topic 4").select("source_element", F.col("confidence").cast("double").alias("confidence"))


@query("select event_id, event_type from events where json_extract_string(props, '$.k') = '7'")
def json_path(spark, d):
    return table(spark, d, "events").filter(filters.json_equals("props", "k", "7")).select("event_id", "event_type")


@query(
    "select vector_id, vector_type from vectors where knowledge_triple_id in (select id from triples where starts_with(source, 'src1')) or concept_node_id in (select id from concepts where abstraction_level = 'HIGH')",
    "triples", "concepts", "vectors",
)
def vectors_of_rows(spark, d):
    triples = by_source_prefix(load(spark, d, "triples"), "src1").select("id")
    return filters.vectors_of(load(spark, d, "vectors"), triples, load(spark, d, "concepts").filter("abstraction_level = 'HIGH'")).select("vector_id", "vector_type")


@query("select id, status from jobs where parent_job_id = 'j7' and stage = 'CONCEPTS' order by created_at, id limit 1", "jobs")
def job_of_stage(spark, d):
    return jobs.job_of_stage(load(spark, d, "jobs"), "j7", "CONCEPTS").select("id", "status")


@query("select id, stage from jobs where status = 'FAILED' order by created_at, id limit 30", "jobs")
def jobs_by_status(spark, d):
    return jobs.by_status(load(spark, d, "jobs"), "FAILED", 30).select("id", "stage")


# -- jobs' transitions

@query(
    """, p as (select id, cast((k * 13) % 140 - 20 as int) v, status, progress, created_at from jobs where k % 3 <> 0), q as (select id, v, least(100, greatest(0, v)) c, status from p)
    select j.id, coalesce(q.c, j.progress) progress, case when q.c = 100 then 'COMPLETED' when q.c > 0 then 'PROCESSING' else j.status end status,
    case when q.c > 0 and q.c < 100 then timestamp '2025-01-01 00:00:00' end started_at, case when q.c = 100 then timestamp '2025-01-01 00:00:00' end completed_at
    from jobs j left join q on j.id = q.id""",
    "jobs",
)
def job_transitions(spark, d):
    j = load(spark, d, "jobs").withColumns({"started_at": F.lit(None).cast("timestamp"), "completed_at": F.lit(None).cast("timestamp")})
    values = j.filter("k % 3 <> 0").select("id", F.expr("cast((k * 13) % 140 - 20 as int)").alias("progress"))
    return jobs.progressed(j, values, "2025-01-01 00:00:00").select("id", "progress", "status", "started_at", "completed_at")


@query("select id, 'QUEUED' status, cast(retry_count + 1 as int) retry_count from jobs where status = 'FAILED' and retry_count < max_retries", "jobs")
def retried_jobs(spark, d):
    return jobs.retried(load(spark, d, "jobs").withColumn("error_message", F.lit("x"))).filter("error_message is null").select("id", "status", "retry_count")


@query(
    """, t as (select *, created_at + k * interval '1' second completed_at from jobs), gone as (select id from t where status in ('COMPLETED', 'FAILED') and completed_at < timestamp '2024-01-01 06:00:00' - interval '0' day)
    select id from t where id not in (select id from gone) and (parent_job_id is null or parent_job_id not in (select id from gone))""",
    "jobs",
)
def purged_jobs(spark, d):
    j = load(spark, d, "jobs").withColumn("completed_at", F.col("created_at") + F.make_interval(secs=F.col("k").cast("decimal(18,6)")))
    return jobs.purged(j, jobs.stale_days(j, 0, "2024-01-01 06:00:00")).select("id")


@query(
    """select id, least(2.0 * pow(2.0, retry_count), 30.0) delay, cast(round(10 + (k % 7) / 7.0 * 70) as int) chunk_progress, round(progress * 1000.0 / nullif(retry_count, 0), 6) rate,
    coalesce(nullif(retry_count, 0), nullif(progress, 0), 0) first_number, cast(1000 * (k + 1) as bigint) ms from jobs""",
    "jobs",
)
def job_measures(spark, d):
    j = load(spark, d, "jobs").withColumns({"started_at": F.col("created_at"), "completed_at": F.col("created_at") + F.make_interval(secs=(F.col("k") + 1).cast("decimal(18,6)"))})
    took = jobs.elapsed_ms(j).withColumnRenamed("id", "of")
    return j.join(took, F.col("id") == F.col("of")).select(
        "id", measures.backoff(2.0, 2.0, F.col("retry_count"), 30.0).alias("delay"), measures.chunk_progress(F.col("k") % 7, F.lit(7)).alias("chunk_progress"),
        F.round(measures.rate(F.col("progress"), F.col("retry_count"), 1000.0), 6).alias("rate"), measures.first_nonzero(F.col("retry_count"), F.col("progress")).alias("first_number"), "ms",
    )


# -- reports

@query("select coalesce(stage, 'unknown') name, cast(count(*) as bigint) n from jobs group by 1", "jobs")
def counts_by_stage(spark, d):
    return report.counts_by(load(spark, d, "jobs"), "stage")


@query(
    """select cast(count(*) as bigint) total, cast(count(*) filter (ok) as bigint) successful, cast(count(*) filter (not ok) as bigint) failed, cast(sum(duration_ms) as bigint) total_duration,
    round(avg(duration_ms), 6) mean_duration from token_usage""",
    "token_usage",
)
def tests_summary(spark, d):
    runs = load(spark, d, "token_usage").select(F.col("ok").alias("success"), F.col("duration_ms").alias("duration"))
    return report.tests_summary(runs).withColumn("mean_duration", F.round("mean_duration", 6))


@query(
    """, m as (select operation_type, avg(duration_ms) mean from token_usage group by 1)
    select round(avg(mean), 6) mean_of_means, arg_min(operation_type, mean) lowest, arg_max(operation_type, mean) highest from m""",
    "token_usage",
)
def grouped_extremes(spark, d):
    return report.grouped_extremes(load(spark, d, "token_usage"), "operation_type", "duration_ms").withColumn("mean_of_means", F.round("mean_of_means", 6))


@query(
    """, g as (select model, avg(total_tokens) efficiency, sum(total_tokens) * 1000.0 / sum(duration_ms) speed from token_usage group by 1)
    select model, cast(row_number() over (order by round(efficiency) desc, speed desc) as int) place from g""",
    "token_usage",
)
def efficiency_ranking(spark, d):
    groups = load(spark, d, "token_usage").groupBy("model").agg(F.avg("total_tokens").alias("efficiency"), (F.sum("total_tokens") * 1000 / F.sum("duration_ms")).alias("speed"))
    return report.by_efficiency(groups).select("model", "place")


@query(
    """, t as (select operation_type || model as name, avg(duration_ms) m, cast(count(*) filter (ok) as double) / count(*) s, sum(total_tokens) * 1000.0 / sum(duration_ms) t from token_usage group by 1)
    select name, case when m > 3000 then 'HIGH' when m > 1500 then 'MEDIUM' else 'LOW' end latency, case when s < 0.9 then 'LOW' else 'HIGH' end reliability, case when t < 20 then 'SLOW' else 'FAST' end speed from t""",
    "token_usage",
)
def bottlenecks(spark, d):
    runs = load(spark, d, "token_usage").withColumn("name", F.concat("operation_type", "model"))
    tests = runs.groupBy("name").agg(F.avg("duration_ms").alias("mean_ms"), (F.count_if("ok") / F.count(F.lit(1))).alias("success_rate"), (F.sum("total_tokens") * 1000 / F.sum("duration_ms")).alias("tokens_per_second"))
    return report.bottlenecks(tests)


@query(
    """, gone as (select id from triples where starts_with(source, 'src1')), topics as (select id, concept, source, source_type from concepts where abstraction_level = 'HIGH')
    select 'triples' name, cast(count(*) as bigint) n from triples where id not in (select id from gone) union all select 'concepts', count(*) from concepts where abstraction_level <> 'HIGH'
    union all select 'vectors', count(*) from vectors where coalesce(knowledge_triple_id, '') not in (select id from gone) and coalesce(concept_node_id, '') not in (select id from topics)
    union all select 'conceptualizations', count(*) from conceptualizations c where not exists (select 1 from topics t where t.concept = c.concept)""",
    "triples", "concepts", "vectors", "conceptualizations",
)
def report_cleanup(spark, d):
    tables = {n: load(spark, d, n) for n in ("triples", "concepts", "vectors", "conceptualizations")}
    # links of the demo graph have no source of their own; they get their concept's
    of = tables["concepts"].select("concept", "source", "source_type").distinct()
    tables["conceptualizations"] = tables["conceptualizations"].join(of, "concept", "left")
    gone = {"triples": by_source_prefix(tables["triples"], "src1").select("id"), "concepts": tables["concepts"].filter("abstraction_level = 'HIGH'").select("id")}
    left, out = report.cleaned(tables, gone), None
    for name, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select array_to_string(list_sort(list(distinct vector_type)), ',') found from vectors", "vectors")
def distinct_types(spark, d):
    return entities.distinct_values(load(spark, d, "vectors"), "vector_type").select(F.array_join("found", ",").alias("found"))


@query("select id, subject, type from triples order by id limit 5", "triples")
def report_samples(spark, d):
    return report.sample(load(spark, d, "triples")).select("id", "subject", "type")


# -- texts

@query("select doc_id, right(text, 5000) log from documents")
def log_tail(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tail(F.col("text")).alias("log"))


@query(r"""select doc_id, array_to_string(list_slice(regexp_split_to_array(text, '\s+'), doc_id % 7 + 1, doc_id % 7 + 5 + doc_id % 20), ' ') said from documents""")
def word_windows(spark, d):
    window = T.word_window(F.col("text"), (F.col("doc_id") % 7).cast("int"), (5 + F.col("doc_id") % 20).cast("int"))
    return table(spark, d, "documents").select("doc_id", window.alias("said"))


@query(
    """, parts as (select type, case when type in ('ENTITY_ENTITY', 'ENTITY_EVENT') then 'entity' else 'event' end kind, subject as part from triples
      union all select type, case when type = 'ENTITY_ENTITY' then 'entity' else 'event' end, object from triples union all select type, 'relationship', predicate from triples),
    n as (select type, kind, part, (row_number() over (partition by type, kind order by part) - 1) // 200 p from (select distinct type, kind, part from parts) x),
    l as (select type, p, coalesce(string_agg(part, ', ' order by part) filter (kind = 'entity'), '') e, coalesce(string_agg(part, ', ' order by part) filter (kind = 'event'), '') v,
      coalesce(string_agg(part, ', ' order by part) filter (kind = 'relationship'), '') r from n group by 1, 2)
    select type, cast(p as int) part, 'Name concepts for these elements.' || chr(10) || 'Entities: ' || e || chr(10) || 'Events: ' || v || chr(10) || 'Relationships: ' || r prompt from l""",
    "triples",
)
def concept_prompts(spark, d):
    return extract.concept_prompt(C.element_sets(load(spark, d, "triples"), "type"), "type", most=200)


@query(
    """, n as (select source, source_type, id, (row_number() over (partition by source, source_type order by id) - 1) // 100 p from triples)
    select source, source_type, cast(p as int) part, string_agg(id, ',' order by id) triple_ids from n group by 1, 2, 3""",
    "triples",
)
def job_triple_ids(spark, d):
    """In hundreds, of all types."""
    ids = C.triple_ids(load(spark, d, "triples"), "source", "source_type", most=100)
    return ids.select("source", "source_type", "part", F.array_join("triple_ids", ",").alias("triple_ids"))


@query(
    """, t as (select source, row_number() over (partition by source order by doc_id) - 1 i, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) tokens from documents)
    select source, cast(floor(i / 100) as int) batch, cast(count(*) as bigint) texts, cast(sum(tokens) as bigint) tokens from t group by 1, 2""".lstrip(", ").replace("t as", "with t as", 1)
)
def embedding_batches(spark, d):
    """Batches of 100 texts within each source, and the tokens of each."""
    texts = table(spark, d, "documents").select("source", "doc_id", T.token_estimate(F.coalesce("text", F.lit(""))).alias("n"))
    docs = numbered(texts, ["source"], ["doc_id"], "i")
    return docs.groupBy("source", measures.batch_number(F.col("i"), 100).alias("batch")).agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("tokens"))


@query(
    """select event_id, event_id % 130 between 1 and 100 and (event_id % 50) / 40.0 <= 1 and event_type <> 'error' ok from events"""
)
def request_validation(spark, d):
    body = F.to_json(F.struct(F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("query"), (F.col("event_id") % 130).alias("limit"), (F.col("event_id") % 50 / 40.0).alias("threshold")))
    lines = table(spark, d, "events").select(F.concat(body, F.lit("#"), "event_id").alias("both")).select(F.split("both", "#")[0].alias("value"), F.split("both", "#")[1].cast("long").alias("event_id"))
    checked = requests(lines.withColumn("value", F.concat(F.rtrim("value"), F.lit(""))), "search").select("raw", "ok").distinct()
    return lines.join(checked, F.col("value") == F.col("raw")).select("event_id", "ok")


@query("select event_id, props said, case when event_id % 2 = 0 then '[REDACTED]' else event_type end hidden from events")
def fences_and_secrets(spark, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    secret = F.when(F.col("event_id") % 2 == 0, "apiKey").otherwise("kind")
    hidden = T.redact_map(F.create_map(secret, F.col("event_type")))
    return table(spark, d, "events").select("event_id", T.strip_fences(fenced).alias("said"), F.map_values(hidden)[0].alias("hidden"))


@query(
    """, u as (select id, duration_ms * 37 s from token_usage) select id, case when s >= 86400 then cast(s // 86400 as varchar(20)) || 'd ' else '' end
    || case when s % 86400 >= 3600 then cast(s % 86400 // 3600 as varchar(20)) || 'h ' else '' end || case when s % 3600 >= 60 then cast(s % 3600 // 60 as varchar(20)) || 'm ' else '' end
    || cast(s % 60 as varchar(20)) || 's' uptime from u""",
    "token_usage",
)
def uptimes(spark, d):
    return load(spark, d, "token_usage").select("id", T.uptime(F.col("duration_ms") * 37).alias("uptime"))


@query("select vec_id, vec_id % 4 <> 0 ok from embeddings")
def vector_checks(spark, d):
    """Every fourth vector has lost its last number."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.expr("if(vec_id % 4 = 0, slice(embedding, 1, 63), embedding)"))
    wrong = store.wrong_dimension(e, 64).select(F.col("vec_id").alias("w"))
    return e.join(wrong, F.col("vec_id") == F.col("w"), "left").select("vec_id", F.col("w").isNull().alias("ok"))


@query(
    """, x as (select id, case when length(id) % 2 = 0 then cast(length(object) as varchar) || '.25' else subject end n, case when length(id) % 3 = 0 then strftime(extracted_at, '%Y-%m-%d %H:%M:%S') else object end t from triples)
    select id, cast(try_cast(n as decimal(5,2)) as double) "number", try_cast(t as timestamp) "time" from x""",
    "triples",
)
def strict_casts(spark, d):
    """Numbers and times in text, among texts that are neither."""
    rows = load(spark, d, "triples").select(
        "id", F.when(F.length("id") % 2 == 0, F.concat(F.length("object").cast("string"), F.lit(".25"))).otherwise(F.col("subject")).alias("number"),
        F.when(F.length("id") % 3 == 0, F.date_format("extracted_at", "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("object")).alias("time"),
    )
    return store.strict_casts(rows, {"number": "decimal(5,2)", "time": "timestamp"}).withColumn("number", F.col("number").cast("double"))


@query("select event_id, event_type <> 'error' and event_id % 130 <= 100 and event_id % 3 <> 0 ok from events")
def payload_validation(spark, d):
    """One bad item rejects a payload of two."""
    item = lambda said, confidence: F.struct(said.alias("subject"), F.lit("p").alias("predicate"), F.lit("o").alias("object"), confidence.alias("confidence"))
    one = item(F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(""), F.col("event_id") % 130 / 100.0)
    other = item(F.lit("s"), F.when(F.col("event_id") % 3 == 0, 1.5).otherwise(0.5))
    return table(spark, d, "events").select("event_id", filters.valid_payload(F.array(one, other)).alias("ok"))
