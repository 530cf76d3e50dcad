"""A graph derived from the test tables, by one SQL text that Spark and other engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import published, register

#: name -> (tables it reads, SQL)
EDGES = """
select 'nation:' || n.n_name subject, 'located in' predicate, 'region:' || r.r_name object, 'ENTITY_ENTITY' type, cast(n.n_nationkey as bigint) k, cast(null as timestamp) source_date
from nation n join region r on n.n_regionkey = r.r_regionkey
union all
select 'supplier:' || cast(s.s_suppkey as varchar(20)), 'based in', 'nation:' || n.n_name, 'ENTITY_ENTITY', s.s_suppkey, cast(null as timestamp)
from supplier s join nation n on s.s_nationkey = n.n_nationkey
union all
select 'customer:' || cast(c.c_custkey as varchar(20)), 'lives in', 'nation:' || n.n_name, 'ENTITY_ENTITY', c.c_custkey, cast(null as timestamp)
from customer c join nation n on c.c_nationkey = n.n_nationkey
union all
select 'supplier:' || cast(l_suppkey as varchar(20)), 'supplies', 'part:' || cast(l_partkey as varchar(20)), 'ENTITY_ENTITY', l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey, l_shipdate
from lineitem
union all
select 'customer:' || cast(o_custkey as varchar(20)), 'placed', 'order:' || cast(o_orderkey as varchar(20)), 'ENTITY_EVENT', o_orderkey, o_orderdate
from orders
union all
select 'user:' || cast(user_id as varchar(20)), 'performed', event_type || ':' || cast(event_id as varchar(20)), 'ENTITY_EVENT', event_id, ts
from events
union all
select a, 'preceded', b, 'EVENT_EVENT', event_id, ts from (
  select event_type || ':' || cast(event_id as varchar(20)) a,
         lead(event_type || ':' || cast(event_id as varchar(20))) over (partition by user_id order by ts, event_id) b, event_id, ts
  from events) e where b is not null
union all
select 'doc:' || cast(doc_id as varchar(20)), 'feels', case when toxic = 1 then 'toxic' else 'calm' end, 'EMOTIONAL_CONTEXT', doc_id, cast(null as timestamp)
from labels
"""
TRIPLES = f"""
select type || ':' || predicate || ':' || cast(k as varchar(20)) id, subject, predicate, object, type,
       'src' || cast(k % 20 as varchar(20)) || '_chunk_' || cast(k % 3 as varchar(20)) source,
       case k % 4 when 0 then 'thread' when 1 then 'file' when 2 then 'manual' else 'api' end source_type, source_date,
       coalesce(source_date, timestamp '2024-01-01 00:00:00') + (k % 100000) * interval '1' minute extracted_at,
       case when k % 17 = 0 then null else cast((k % 101) / 100.0 as decimal(3,2)) end confidence
from ({EDGES}) e
"""
CONCEPTS = """
select 'c' || cast(label as varchar(20)) id, 'Topic ' || cast(label as varchar(20)) concept,
       case label % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end abstraction_level,
       cast((label % 101) / 100.0 as decimal(3,2)) confidence, 'src' || cast(label as varchar(20)) source, 'file' source_type
from (select distinct label from embeddings) l
"""
CONCEPTUALIZATIONS = """
select 'nation:' || n_name source_element, 'Topic ' || cast(n_nationkey % 10 as varchar(20)) concept, cast((n_nationkey % 101) / 100.0 as decimal(3,2)) confidence from nation
union all
select 'supplier:' || cast(s_suppkey as varchar(20)), 'Topic ' || cast(s_suppkey % 10 as varchar(20)), cast((s_suppkey % 101) / 100.0 as decimal(3,2)) from supplier
union all
select p, 'Topic ' || cast(length(p) % 10 as varchar(20)), cast(0.5 as decimal(3,2)) from (select 'located in' p union all select 'based in' union all select 'feels') x
"""
VECTORS = """
select 'v' || cast(vec_id as varchar(20)) vector_id, embedding,
       case vec_id % 3 when 0 then 'SEMANTIC' when 1 then 'ENTITY' else 'RELATIONSHIP' end vector_type,
       'ENTITY_ENTITY:lives in:' || cast(vec_id as varchar(20)) knowledge_triple_id, cast(null as varchar(20)) concept_node_id from embeddings
union all
select 'w' || cast(vec_id as varchar(20)), embedding, 'CONCEPT', cast(null as varchar(20)), 'c' || cast(label as varchar(20)) from embeddings
"""
USAGE = """
select event_id id, 'src' || cast(user_id % 20 as varchar(20)) source, event_type operation_type,
       case event_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'google' end provider,
       case event_id % 4 when 0 then 'openai/model-a' when 1 then 'model-b' when 2 then 'model-c' else 'vendor/unknown' end model,
       cast(event_id % 5000 as bigint) input_tokens, cast(event_id % 700 as bigint) output_tokens, cast(event_id % 5000 + event_id % 700 as bigint) total_tokens,
       case when event_id % 2 = 0 then cast(event_id % 90 as bigint) end thinking_tokens, case when event_id % 3 = 0 then cast(event_id % 40 as bigint) end reasoning_tokens,
       cast(event_id % 4000 + 1 as bigint) duration_ms, event_id % 10 <> 0 ok, ts as "timestamp"
from events
"""
PRICES = """
select 'model-a' price_model, 0.5 price_in, 1.5 price_out, 2.0 price_thinking, 2.5 price_reasoning
union all select 'model-b', 0.25, 0.75, 1.0, 1.25 union all select 'model-c', 0.1, 0.4, 0.5, 0.6
"""
JOBS = """
select 'j' || cast(doc_id as varchar(20)) id, 'PROCESS_KNOWLEDGE' job_type, cast(null as varchar(20)) parent_job_id, cast(null as varchar(20)) stage,
       'PROCESSING' status, cast(50 as int) progress, cast(0 as int) retry_count, cast(3 as int) max_retries, timestamp '2024-01-01 00:00:00' + doc_id * interval '1' minute created_at, doc_id k
from documents
union all
select 'j' || cast(doc_id as varchar(20)) || '-' || cast(s as varchar(20)), case s when 0 then 'EXTRACTION' when 1 then 'CONCEPTS' else 'DEDUPLICATION' end, 'j' || cast(doc_id as varchar(20)),
       case s when 0 then 'EXTRACTION' when 1 then 'CONCEPTS' else 'DEDUPLICATION' end,
       case (doc_id + s) % 5 when 0 then 'QUEUED' when 1 then 'PROCESSING' when 2 then 'FAILED' else 'COMPLETED' end, cast((doc_id * 7 + s) % 101 as int),
       cast(doc_id % 5 as int), cast(3 as int), timestamp '2024-01-01 00:00:00' + (doc_id + s) * interval '1' minute, doc_id
from documents cross join (select 0 s union all select 1 union all select 2) stages
"""

GRAPH = {
    "triples": (["nation", "region", "supplier", "customer", "lineitem", "orders", "events", "labels"], TRIPLES),
    "concepts": (["embeddings"], CONCEPTS),
    "conceptualizations": (["nation", "supplier"], CONCEPTUALIZATIONS),
    "vectors": (["embeddings"], VECTORS),
    "token_usage": (["events"], USAGE),
    "prices": ([], PRICES),
    "jobs": (["documents"], JOBS),
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = GRAPH[name]
    register(spark, sf_dir, tables)
    return spark.sql(sql.replace('"timestamp"', "`timestamp`"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the graph: derived and written at its first use in a session, as a store's tables are, and then read."""
    return published(spark, lambda: derive(spark, sf_dir, name), f"{sf_dir}/{name}")


def as_ctes(*names: str) -> str:
    """The same tables as the head of a query."""
    return "with " + ",\n".join(f"{n} as ({GRAPH[n][1]})" for n in names)
