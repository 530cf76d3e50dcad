"""Jobs as a stream of files: due jobs run in micro-batches, and their outcomes are events again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .job_state import FIELDS, FINAL, OUT, SLOTS, STATE, Pipelines, Rules

EVENT = (
    "id string, event_time timestamp, job_type string, parent_job_id string, stage string, status string, progress int, retry_count int, max_retries int, "
    "text string, metadata string, result string, error_message string, not_before timestamp"
)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # a state store that keyed state with timers needs
Handler = Callable[[DataFrame], DataFrame]


def enqueue(spark: SparkSession, events_dir: str, jobs: DataFrame) -> None:
    """Append jobs' events to the folder that the stream reads."""
    fields = spark.createDataFrame([], EVENT).schema.fields
    shaped = jobs.select(*[(F.col(f.name) if f.name in jobs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    shaped.write.mode("append").json(events_dir)


def dispatch(queued: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """The events of queued jobs: each type's handler gives its own, jobs of other types fail."""
    unknown = queued.filter(~F.coalesce(F.col("job_type").isin(list(handlers)), F.lit(False)))
    out = unknown.withColumns({"status": F.lit("FAILED"), "error_message": F.concat(F.lit("no handler for "), F.coalesce("job_type", F.lit("a job without type")))})
    for kind, handle in handlers.items():
        mine = queued.filter(F.col("job_type") == kind)
        if not mine.isEmpty():
            out = out.unionByName(handle(mine))
    return out


def run_jobs(
    spark: SparkSession, events_dir: str, done_dir: str, checkpoint: str, handlers: dict[str, Handler], rules: Rules = Rules(), every: str = "1 second",
) -> StreamingQuery:
    """A stream that runs jobs when they are due, schedules what follows, and tries failed ones again, until it is stopped.

    Events (jobs that are asked for, and outcomes) come from ``events_dir``.  Each
    micro-batch hands due jobs to their type's handler, whose outcomes go back there, and
    writes what jobs have come to into ``done_dir``, in a folder of its own that a repeated
    batch overwrites.  A batch that is repeated runs its handlers again; its outcomes are
    repetitions that the state leaves aside.  A handler that raises stops the stream
    before the batch counts, and a restart from the checkpoint repeats it.
    """
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    times = ("event_time", "not_before")
    told = F.to_json(F.struct(*[F.unix_micros(c).alias(c) if c in times else F.col(c) for c in FIELDS]), {"ignoreNullFields": "true"})
    events = spark.readStream.schema(EVENT).json(events_dir).filter("id is not null").select(F.coalesce("parent_job_id", "id").alias("pipeline"), told.alias("event"))
    dealt = events.select(F.pmod(F.xxhash64("pipeline"), F.lit(SLOTS)).cast("int").alias("slot"), "pipeline", "event")
    moved = dealt.groupBy("slot").transformWithState(Pipelines(rules), OUT, "Update", "ProcessingTime")
    moved = moved.select("kind", F.from_json("told", STATE.replace("kind string, ", "").replace("timestamp", "long"), {"mode": "FAILFAST"}).alias("told")).select("kind", "told.*")
    moved = moved.withColumns({c: F.timestamp_micros(c) for c in times})

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.drop("kind").write.mode("overwrite").parquet(f"{done_dir}/batch={number}")
            due = batch.filter("kind = 'run'").drop("kind", "pipeline")
            if not due.isEmpty():
                enqueue(spark, events_dir, dispatch(due, handlers))
        finally:
            batch.unpersist()

    return moved.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("update").foreachBatch(step).start()


def _rows(spark: SparkSession, done_dir: str) -> DataFrame:
    return spark.read.schema(f"{STATE.replace('kind string, ', '')}, batch long").parquet(done_dir)


def job_states(spark: SparkSession, done_dir: str, *columns: str) -> DataFrame:
    """What each job has come to (all columns, or id and those): the last row that the stream wrote of it."""
    rows = _rows(spark, done_dir)
    told = columns or ["event_time", *[c for c in rows.columns if c not in ("id", "event_time", "batch")]]
    last = rows.groupBy("id").agg(F.max_by(F.struct(*told), F.struct("batch", "event_time", "retry_count", F.col("status").isin(*FINAL))).alias("s"))
    return last.select("id", "s.*")


def wait_until_final(query: StreamingQuery, spark: SparkSession, done_dir: str, jobs: int, seconds: float) -> None:
    """Wait until so many jobs are final, then stop the stream; a TimeoutError after ``seconds``.

    A job becomes final once, so each batch that has ended is read and counted once.
    """
    end, final, counted = time.time() + seconds, 0, -1
    try:
        while time.time() < end:
            if query.exception():
                raise query.exception()
            ended = max((p["batchId"] for p in query.recentProgress if "addBatch" in p["durationMs"]), default=-1)  # others had nothing to do
            if ended > counted:
                final += _rows(spark, done_dir).filter((F.col("batch") > counted) & (F.col("batch") <= ended) & F.col("status").isin(*FINAL)).count()
                counted = ended
                if final >= jobs:
                    return
            time.sleep(0.5)
        raise TimeoutError(f"not all of {jobs} jobs came to an end")
    finally:
        query.stop()


def graph_handlers(graph, at: str) -> dict[str, Handler]:
    """What a knowledge graph does with each type of job."""
    of = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)

    def finished(batch: DataFrame, said: DataFrame, same) -> DataFrame:
        """``said``: (r, m) and what ``same`` compares; the message makes a job fail."""
        failed = F.col("m").isNotNull()
        return batch.join(said, same, "left").withColumns({
            "status": F.when(failed, "FAILED").otherwise("COMPLETED"), "progress": F.when(failed, 0).otherwise(100), "result": F.col("r"), "error_message": F.col("m"),
        }).select(*batch.columns)

    def extraction(batch: DataFrame) -> DataFrame:
        found = graph.extraction_job(batch.select("id", "text", of("source"), of("source_type"), F.col("retry_count").alias("attempt")), at)
        said = found.select(F.col("id").alias("d"), F.to_json(F.struct("triples", "total_chunks", "successful_chunks", "failed_chunks", "ms")).alias("r"), F.col("error_message").alias("m"))
        return finished(batch, said, F.col("id") == F.col("d"))

    def by_source(job: Handler) -> Handler:
        def handle(batch: DataFrame) -> DataFrame:
            out = job(batch.select(of("source"), of("source_type")), at)
            said = out.select(F.col("source").alias("s"), F.col("source_type").alias("t"), F.to_json(F.struct(*out.columns[2:])).alias("r"), F.lit(None).cast("string").alias("m"))
            return finished(batch, said, of("source").eqNullSafe(F.col("s")) & of("source_type").eqNullSafe(F.col("t")))

        return handle

    return {
        "PROCESS_KNOWLEDGE": extraction, "EXTRACT_KNOWLEDGE_BATCH": extraction,
        "GENERATE_CONCEPTS": by_source(graph.concept_job), "DEDUPLICATE_KNOWLEDGE": by_source(graph.dedup_job),
    }


def usage_windows(usage: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tokens by tumbling window; works on a stream and on a table."""
    rows = usage.withWatermark("timestamp", late) if usage.isStreaming else usage
    return rows.groupBy(F.window("timestamp", size), "operation_type").agg(F.sum("total_tokens").alias("tokens"), F.count(F.lit(1)).alias("calls"))
