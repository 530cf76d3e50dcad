"""The graph's verbs over a store of published tables; each gives a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.measures import processing_delay
from .functions.text import semantic_text
from .operators import concepts as C
from .operators import dedup, entities, extract, fusion, jobs, search, store, usage
from .operators.filters import Scope
from .schema import CODEC, CONCEPTS, CONCEPTUALIZATIONS, DICTIONARY, JOBS, TOKEN_USAGE, TRIPLE_KEY, TRIPLE_TYPES, TRIPLES, VECTORS

SCHEMAS = {"triples": TRIPLES, "concepts": CONCEPTS, "conceptualizations": CONCEPTUALIZATIONS, "vectors": VECTORS, "jobs": JOBS, "token_usage": TOKEN_USAGE, "dictionary": DICTIONARY}
#: What tells a table's rows apart; a row whose key is stored already is not stored again.
UNIQUE = {
    "triples": TRIPLE_KEY, "concepts": ["concept", "abstraction_level", "source", "source_type"], "conceptualizations": ["source_element", "triple_type", "concept"],
    "vectors": ["vector_id"], "token_usage": ["id"], "dictionary": ["digest", "model"],
}
#: What is counted with each publication, so that statistics don't read the tables.
VIEWS = {"triples": {"entities": entities.entity_counts, "kinds": entities.kind_counts}, "concepts": {"levels": entities.level_counts}}
CHUNK = "_chunk_"


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the schema's columns in its order; those it lacks are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")


def source_root(c):
    """A document's source, without the number of the chunk."""
    return F.regexp_replace(c, f"{CHUNK}[0-9]+$", "")


class KnowledgeGraph:
    """Extraction, concepts, dedup and vectors as jobs; searches read what is published.

    ``extractor``, ``embedder`` and ``conceptualizer`` can be replaced by ones that ask a
    service; ``semantic_dedup`` is the similarity from which on a job's triples count as
    one, or None for exact dedup alone; ``context`` is how many triples of its source a
    relationship of a concept names; ``model`` names the embedder: another one needs
    another name, as texts that were embedded under it are not embedded again.
    """

    def __init__(
        self, spark: SparkSession, root: str, extractor: extract.Extractor = extract.rule_extractor, embedder: Callable[[list[str]], np.ndarray] = extract.hash_embedder,
        conceptualizer: Callable[..., DataFrame] = extract.bucket_concepts, semantic_dedup: float | None = None, dimension: int = 64, prices: DataFrame | None = None,
        context: int = 5, model: str = "default",
    ):
        self.spark, self.root, self.extractor, self.embedder, self.conceptualizer = spark, root.rstrip("/"), extractor, embedder, conceptualizer
        self.semantic_dedup, self.dimension, self.prices, self.context = semantic_dedup, dimension, prices, context
        self.model = model
        self.store = store.Store(spark, self.root, UNIQUE, VIEWS)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, SCHEMAS[name])

    def _staged(self, df: DataFrame) -> DataFrame:
        """Written once, so that what follows doesn't extract or embed again; nothing names the folder."""
        folder = f"{self.root}/staging/{uuid.uuid4().hex}"
        df.write.parquet(folder, compression=CODEC)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _publish(self, appended: dict[str, DataFrame], deleted: dict[str, DataFrame] | None = None, as_of: int | None = None) -> None:
        self.store.publish(appended, None, SCHEMAS, deleted=deleted, keys=UNIQUE, as_of=as_of)

    def publish_rows(self, name: str, rows: DataFrame) -> None:
        """Append a table's rows as they are, such as those of another graph."""
        self._publish({name: _shaped(rows, SCHEMAS[name])})

    def _dictionary(self, texts: DataFrame) -> DataFrame:
        """(text, embedding) of the distinct texts; only texts that the model hasn't embedded before go to the embedder.

        Embeddings are stored by their text's digest and the model's name, and published
        before they are used, so that a batch that fails later has not asked in vain.
        """
        digest = F.sha2("text", 256)
        wanted = texts.filter("text is not null").select("text").distinct()
        as_of, now = self.store.manifest()
        known = bool(now.get("dictionary", {}).get("data"))
        stored = self.store.read("dictionary", DICTIONARY, now).filter(F.col("model") == self.model).select("digest", "embedding")
        if known:
            wanted = self._staged(wanted)
        new = wanted.join(stored.select("digest"), digest == F.col("digest"), "left_anti") if known else wanted
        rows = extract.embed_distinct(new, self.embedder).withColumns({"digest": digest, "model": F.lit(self.model)})
        folder = self.store.write("dictionary", _shaped(rows, DICTIONARY))  # what is published is what is used
        made = self.spark.read.schema(DICTIONARY).parquet(folder)
        if not made.isEmpty():
            store.checked_vectors(made.withColumn("vector_id", F.col("digest")), self.dimension)
            self._publish({"dictionary": folder}, as_of=as_of)
        made = made.select("text", "embedding")
        return wanted.join(stored, digest == F.col("digest")).select("text", "embedding").unionByName(made) if known else made

    # -- storing

    def store_triples(self, raw: DataFrame) -> DataFrame:
        """Store triples that aren't stored yet, with their vectors; one row: triples_stored, duplicates_skipped, vectors_generated."""
        given = self._staged(_shaped(store.cleaned_triples(raw), TRIPLES))
        new = self._staged(_shaped(self.store.new_rows("triples", self._staged(_shaped(dedup.exact_dedup(given), TRIPLES)), TRIPLES), TRIPLES))
        vectors = self._staged(store.checked_vectors(_shaped(store.materialise_vectors(new, self._dictionary(store.vector_texts(new).select("text"))), VECTORS), self.dimension))
        self._publish({"triples": new, "vectors": vectors})
        n, stored, made = given.count(), new.count(), vectors.count()
        return self.spark.createDataFrame([(stored, n - stored, made)], "triples_stored bigint, duplicates_skipped bigint, vectors_generated bigint")

    def store_concepts(self, raw: DataFrame) -> DataFrame:
        """Store concepts that aren't stored yet, with their vectors; one row of counts."""
        given = self._staged(_shaped(store.cleaned_concepts(raw), CONCEPTS))
        new = self._staged(_shaped(self.store.new_rows("concepts", given, CONCEPTS), CONCEPTS))
        vectors = self._staged(store.checked_vectors(_shaped(store.concept_vectors(new, self._dictionary(new.select(F.col("concept").alias("text")))), VECTORS), self.dimension))
        self._publish({"concepts": new, "vectors": vectors})
        n, stored, made = given.count(), new.count(), vectors.count()
        return self.spark.createDataFrame([(stored, n - stored, made)], "concepts_stored bigint, duplicates_skipped bigint, vectors_generated bigint")

    def track_usage(self, rows: DataFrame, at: str) -> None:
        """Append token usage rows, with their cost where the model's price is known."""
        if self.prices is not None:
            rows = usage.usage_costs(rows, self.prices).withColumn("estimated_cost", F.col("cost"))
        rows = rows.withColumns({"id": F.coalesce(F.col("id"), F.uuid()) if "id" in rows.columns else F.uuid(), "timestamp": F.lit(at).cast("timestamp")})
        self._publish({"token_usage": _shaped(rows, TOKEN_USAGE)})

    # -- jobs; each takes (source, source_type) rows and gives (source, source_type, result as JSON, error_message)

    def _usage_of(self, rows: DataFrame, docs: DataFrame, at: str) -> DataFrame:
        """Usage rows that aren't stored yet: a call counts once for a run, a job's attempt, a chunk and its number, however often a batch is repeated."""
        used = extract.usage_rows(rows)
        attempts = docs.select(F.col("id").alias("doc"), (F.col("attempt") if "attempt" in docs.columns else F.lit(0)).cast("string").alias("attempt"))
        used = used.join(attempts, "doc", "left").withColumn("id", F.sha2(F.to_json(F.struct(F.lit(at).alias("at"), "doc", "attempt", "chunk", "call")), 256))
        return store.new_rows(used, self.table("token_usage"), ["id"]).drop("doc", "attempt", "chunk", "call")

    def extraction_job(self, docs: DataFrame, at: str) -> DataFrame:
        """Chunk, extract, merge and store docs (id, text, source, source_type, attempt or none); failing chunks are left out.

        Gives (id, triples, total_chunks, successful_chunks, failed_chunks, error_message, ms):
        the message only where nothing but failures came of a document.
        """
        began = self.spark.sql("select unix_millis(current_timestamp())").first()[0]
        time = F.lit(at).cast("timestamp")
        rows = self._staged(extract.extraction_rows(docs, TRIPLE_TYPES, self.extractor))
        self.store_triples(rows.filter("row = 'triple'").withColumn("extracted_at", time))
        used = self._usage_of(rows, docs, at)
        if not used.isEmpty():
            self.track_usage(used, at)
        counts = extract.chunk_counts(rows, "doc").withColumnRenamed("doc", "of")
        said = rows.groupBy(F.col("doc").alias("doc")).agg(F.count_if(F.col("row") == "triple").alias("triples"), F.min(F.when(F.col("row") == "chunk", F.col("error"))).alias("first_error"))
        found = counts.join(said, F.col("of") == F.col("doc"))
        ended = self.spark.sql("select unix_millis(current_timestamp())").first()[0]
        none = F.lit(0).cast("long")
        return self._staged(docs.select("id").join(found, F.col("id") == F.col("of"), "left").select(
            "id", *[F.coalesce(c, none).alias(c) for c in ("triples", "total_chunks", "successful_chunks", "failed_chunks")],
            F.when((F.col("failed_chunks") > 0) & (F.col("successful_chunks") == 0), F.col("first_error")).alias("error_message"), F.lit(ended - began).alias("ms"),
        ))

    def _of_sources(self, table: DataFrame, sources: DataFrame) -> DataFrame:
        """Rows of the given documents' chunks: an equality on the source without its chunk, so that ``src1`` isn't ``src10``."""
        named = sources.select(F.col("source").alias("root"), F.col("source_type").alias("root_type")).distinct()
        named = self._staged(named)  # of a known size, so that few sources are sent to the table's rows
        rooted = table.withColumn("source_root", source_root(F.col("source")))
        return rooted.join(named, F.col("source_root").eqNullSafe(F.col("root")) & F.col("source_type").eqNullSafe(F.col("root_type")), "left_semi")

    def concept_job(self, sources: DataFrame, at: str) -> DataFrame:
        """Concepts of the triples of (source, source_type) rows; sources that have concepts already are skipped.

        Gives (source, source_type, concepts_stored, relationships_stored, skipped).
        """
        time = F.lit(at).cast("timestamp")
        sources = sources.select("source", "source_type").distinct()
        known = self.table("concepts").select(F.col("source").alias("s"), F.col("source_type").alias("t")).distinct()
        same = F.col("source").eqNullSafe(F.col("s")) & F.col("source_type").eqNullSafe(F.col("t"))
        todo = sources.join(known, same, "left_anti")
        by = ["source", "source_type"]
        triples = self._staged(self._of_sources(self.table("triples"), todo).drop("source").withColumnRenamed("source_root", "source"))
        related = self._staged(self.conceptualizer(C.element_sets(triples, *by), *by))
        named = related.select(*by, "concept", "abstraction_level").distinct().withColumns({"confidence": F.lit(1.0), "extracted_at": time})
        concepts = self._staged(_shaped(store.cleaned_concepts(named), CONCEPTS))
        context = C.context_triples(triples, related, self.context, by).groupBy("source_element", "concept", *by).agg(F.array_sort(F.collect_list("id")).alias("context_triples"))  # `context` ids at most
        links = related.select(*by, "source_element", "concept", F.col("kind").alias("triple_type")).distinct()
        links = links.join(context.toDF("_e", "_c", "_s", "_t", "context_triples"), (F.col("source_element") == F.col("_e")) & (F.col("concept") == F.col("_c")) & F.col("source").eqNullSafe(F.col("_s")) & F.col("source_type").eqNullSafe(F.col("_t")), "left").drop("_e", "_c", "_s", "_t")
        links = links.withColumns({"confidence": F.lit(1.0), "extracted_at": time}).withColumn("id", store.conceptualization_id())
        links = self._staged(_shaped(links, CONCEPTUALIZATIONS))
        vectors = store.checked_vectors(_shaped(store.concept_vectors(concepts, self._dictionary(concepts.select(F.col("concept").alias("text")))), VECTORS), self.dimension)
        new_links = _shaped(self.store.new_rows("conceptualizations", links, CONCEPTUALIZATIONS), CONCEPTUALIZATIONS)
        self._publish({"concepts": concepts, "conceptualizations": new_links, "vectors": vectors})
        made = concepts.groupBy(*by).agg(F.count(F.lit(1)).alias("concepts")).toDF("s1", "t1", "c1")
        linked = links.groupBy(*by).agg(F.count(F.lit(1)).alias("links")).toDF("s2", "t2", "c2")
        out = sources.join(known.withColumn("k", F.lit(True)), same, "left")
        out = out.join(made, F.col("source").eqNullSafe(F.col("s1")) & F.col("source_type").eqNullSafe(F.col("t1")), "left")
        out = out.join(linked, F.col("source").eqNullSafe(F.col("s2")) & F.col("source_type").eqNullSafe(F.col("t2")), "left")
        none = F.lit(0).cast("long")
        return self._staged(out.select(*by, F.coalesce("c1", none).alias("concepts_stored"), F.coalesce("c2", none).alias("relationships_stored"), F.coalesce("k", F.lit(False)).alias("skipped")))

    def dedup_job(self, sources: DataFrame, at: str) -> DataFrame:
        """Merge alike triples of each of (source, source_type) rows, and delete what was merged, with its vectors.

        Survivors keep the best confidence and the last extraction.  Gives (source,
        source_type, original, remaining, removed, skipped).
        """
        by = ["source", "source_type"]
        sources = sources.select(*by).distinct()
        if self.semantic_dedup is None:
            zero = F.lit(0).cast("long")
            return sources.select(*by, zero.alias("original"), zero.alias("remaining"), zero.alias("removed"), F.lit(True).alias("skipped"))
        as_of = self.store.manifest()[0]
        triples = self._staged(self._of_sources(self.table("triples"), sources).withColumn("source_root", F.concat_ws("\u001f", "source_root", "source_type")))
        dictionary = self._dictionary(triples.select(semantic_text().alias("text")))
        exact, survivors = dedup.merged_keys(triples, dictionary, self.semantic_dedup, stage=self._staged)
        keyed = lambda df: df.withColumns(dict(zip(dedup.KEY_BITS, dedup.key_bits())))
        kept = keyed(exact).join(survivors.select(*dedup.KEY_BITS), dedup.KEY_BITS, "left_semi")
        gone = keyed(triples.select("id", *TRIPLE_KEY)).join(survivors.select(*dedup.KEY_BITS), dedup.KEY_BITS, "left_anti").select("id", *TRIPLE_KEY)
        merged = keyed(exact).drop("confidence", "extracted_at").join(survivors.filter("n_merged > 1").drop("n_merged"), dedup.KEY_BITS)
        merged = self._staged(_shaped(merged, TRIPLES))
        deleted = {"triples": gone.select(*TRIPLE_KEY).unionByName(merged.select(*TRIPLE_KEY))}
        if self.store.holds("vectors", as_of):
            gone = self._staged(gone)
            deleted["triples"] = gone.select(*TRIPLE_KEY).unionByName(merged.select(*TRIPLE_KEY))
            deleted["vectors"] = store.vectors_to_delete(gone, self.table("triples"))
        # what is written follows the sources' rows, not the tables
        self._publish({"triples": merged}, deleted, as_of)
        count = lambda df, name: df.groupBy(source_root(F.col("source")).alias("source"), "source_type").agg(F.count(F.lit(1)).alias(name))
        all_, left = count(triples, "original").toDF("s1", "t1", "original"), count(kept, "remaining").toDF("s2", "t2", "remaining")
        out = sources.join(all_, F.col("source").eqNullSafe(F.col("s1")) & F.col("source_type").eqNullSafe(F.col("t1")), "left")
        out = out.join(left, F.col("source").eqNullSafe(F.col("s2")) & F.col("source_type").eqNullSafe(F.col("t2")), "left").fillna(0, ["original", "remaining"])
        return self._staged(out.select(*by, "original", "remaining", (F.col("original") - F.col("remaining")).alias("removed"), F.lit(False).alias("skipped")))

    # -- verbs

    def process_knowledge(self, docs: DataFrame, at: str) -> DataFrame:
        """Run the jobs of docs (id, text, source, source_type); gives the jobs with the states they came to.

        A document fails only if all its chunks do; its later stages then still run on
        what is stored of its source.  Dedup has a job only where it is switched on.
        """
        docs = self._staged(docs)
        time = F.lit(at).cast("timestamp")
        found = self.extraction_job(docs, at)
        concepts = self.concept_job(docs, at)
        deduped = self.dedup_job(docs, at) if self.semantic_dedup is not None else None
        with_base = docs.join(found.select(F.col("id").alias("of"), "ms", "triples"), F.col("id") == F.col("of"), "left")
        events = jobs.pipeline_events(with_base, at, deduped is not None, processing_delay(F.coalesce("ms", F.lit(0)), F.coalesce("triples", F.lit(0))))
        said = found.select(F.concat(F.lit("job-"), "id", F.lit("-extraction")).alias("j"), F.to_json(F.struct("triples", "total_chunks", "successful_chunks", "failed_chunks")).alias("r"), F.col("error_message").alias("m"))
        by_source = lambda out, stage, *cols: docs.select(F.col("id").alias("d"), F.col("source").alias("ds"), F.col("source_type").alias("dt")).join(
            out, F.col("ds").eqNullSafe(F.col("source")) & F.col("dt").eqNullSafe(F.col("source_type"))
        ).select(F.concat(F.lit("job-"), "d", F.lit(f"-{stage}")).alias("j"), F.to_json(F.struct(*cols)).alias("r"), F.lit(None).cast("string").alias("m"))
        said = said.unionByName(by_source(concepts, "concepts", "concepts_stored", "relationships_stored", "skipped"))
        if deduped is not None:
            said = said.unionByName(by_source(deduped, "deduplication", "original", "remaining", "removed", "skipped"))
        done = events.join(said, F.col("id") == F.col("j"), "left")
        failed = F.col("m").isNotNull()
        child = F.col("parent_job_id").isNotNull()
        done = done.withColumns({
            "status": F.when(failed, "FAILED").when(child & F.col("r").isNotNull(), "COMPLETED").otherwise(F.col("status")), "progress": F.when(failed, 0).when(child, 100).otherwise(100),
            "result": F.col("r"), "metrics": F.col("r"), "error_message": F.col("m"), "retry_count": F.lit(0), "max_retries": F.lit(3),
            "created_at": time, "started_at": time, "completed_at": F.when(child, F.current_timestamp()),
        })
        states = jobs.pipeline_complete(done).select(F.col("parent").alias("p"), F.col("status").alias("whole"))
        done = done.join(states, F.col("id") == F.col("p"), "left").withColumn("status", F.coalesce("whole", "status"))
        done = self._staged(_shaped(done, JOBS))
        self._publish({"jobs": done})
        return done

    def get_pipeline_status(self, parent_id: str) -> DataFrame:
        """One row with the map of the stages' states, as the last batch left them; none if there is no such job."""
        events = self.table("jobs").filter((F.col("id") == parent_id) | (F.col("parent_job_id") == parent_id)).withColumn("event_time", F.col("created_at"))
        return jobs.pipeline_overview(jobs.latest_state(events))

    def search_knowledge_graph(self, query: str, limit: int = 10, threshold: float = 0.7, scope: Scope = Scope(), weights: dict[str, float] | None = None, legs: tuple[str, ...] = fusion.LEGS) -> DataFrame:
        """Fused search; ``threshold`` is the least vector score, and 0 means 0."""
        _within("limit", limit, 1, 100)
        _within("threshold", threshold, 0, 1)
        for name, w in (weights or {}).items():
            _within(f"weight of {name}", w, 0, 1)
        if not legs or set(legs) - set(fusion.LEGS):
            raise ValueError(f"legs must be some of {fusion.LEGS}, not {legs}")
        triples, vectors = self.table("triples"), self.table("vectors")
        vector = self.embedder([query])[0].tolist()
        found = {
            "entity": lambda: (search.search_entity(triples, query, scope, limit), [F.desc("subject"), F.desc("object"), F.desc("extracted_at"), "id"]),
            "relationship": lambda: (search.search_relationship(triples, query, scope, limit), [F.desc("predicate"), F.desc("extracted_at"), "id"]),
            "semantic": lambda: (search.search_semantic(triples, vectors, vector, threshold, limit, scope), [F.desc("score"), "id"]),
            "concept": lambda: (
                search.concept_triples(triples, self.table("concepts"), self.table("conceptualizations"), vectors, vector, threshold, limit, scope),
                [F.desc("concept_score"), "id"],
            ),
        }
        scored = [fusion.leg_scores(ranked, leg, order) for leg in fusion.LEGS if leg in legs for ranked, order in [found[leg]()]]
        return fusion.fuse(scored, weights, limit)

    def search_by_text(self, query: str, limit: int = 10, threshold: float = 0.7, scope: Scope = Scope()) -> tuple[DataFrame, DataFrame]:
        """Fused search that leans on meaning, and its triples' source dates by month."""
        hits = self._staged(self.search_knowledge_graph(query, limit, threshold, scope, fusion.TEXT_WEIGHTS))  # `limit` rows
        dated = self.table("triples").join(F.broadcast(hits.select(*TRIPLE_KEY)), TRIPLE_KEY, "left_semi")
        return hits, entities.temporal_clusters(dated)

    def search_by_embedding(self, vector: list[float], limit: int = 10, threshold: float = 0.7, scope: Scope = Scope()) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nearest triples, nearest concepts where there are no such triples, and the triples' source dates by month."""
        _within("limit", limit, 1, 100)
        return search.search_with_fallback(self.table("triples"), self.table("concepts"), self.table("vectors"), vector, threshold, limit, scope)

    def search_concepts(self, query: str, level: str | None = None, limit: int = 50) -> DataFrame:
        return search.search_concepts(self.table("concepts"), query, level, limit)

    def get_knowledge_graph_stats(self) -> DataFrame:
        """One row: totals, and a map with the count of every type; from the publications' counts."""
        now = self.store.manifest()[1]
        counted, levels = self.store.view("triples", "kinds", TRIPLES, now), self.store.view("concepts", "levels", CONCEPTS, now)
        every = counted.sparkSession.createDataFrame([(k,) for k in TRIPLE_TYPES], "type string")
        kinds = F.broadcast(every).join(counted.groupBy("type").agg(F.sum("n").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
        kinds = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("triples_by_type"))
        return entities.stats_counted(counted, levels).crossJoin(kinds)  # one row each

    def enumerate_entities(self, role: str = "both", min_occurrence: int = 1, sort: str = "frequency", limit: int | None = None) -> DataFrame:
        """Entities with their occurrences, roles, sources and types; from the publications' counts."""
        return entities.enumerate_counted(self.store.view("triples", "entities", TRIPLES, by=entities.COUNTED_BY), role, min_occurrence, sort, limit)
