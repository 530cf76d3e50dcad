"""Jobs: an append-only event log, the latest state, and questions about pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import stage_delay
from ..schema import JOB_STAGES, JOB_STATUSES

STAGE_JOBS = {"EXTRACTION": "EXTRACT_KNOWLEDGE_BATCH", "CONCEPTS": "GENERATE_CONCEPTS", "DEDUPLICATION": "DEDUPLICATE_KNOWLEDGE"}


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each job is its state; combined within tasks."""
    rest = [c for c in events.columns if c not in ("id", "event_time")]
    return events.groupBy("id").agg(F.max(F.struct("event_time", *rest)).alias("s")).select("id", "s.*")


def queue_stats(jobs: DataFrame) -> DataFrame:
    """One row with a count for each status, in a single pass."""
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in JOB_STATUSES])


def pipeline_status(jobs: DataFrame) -> DataFrame:
    """(parent, stage, status, progress, times, metrics): of several jobs for a stage the last created one counts."""
    rest = ["status", "progress", *[c for c in ("started_at", "completed_at", "metrics") if c in jobs.columns]]
    last = F.max(F.struct("created_at", "id", *rest)).alias("s")
    children = jobs.filter("parent_job_id is not null").groupBy(F.col("parent_job_id").alias("parent"), "stage").agg(last)
    return children.select("parent", "stage", *[f"s.{c}" for c in rest])


def pipeline_overview(jobs: DataFrame) -> DataFrame:
    """One row for each parent, whose state follows its children's: the map of its stages' states."""
    states = pipeline_status(jobs)
    state = F.struct(*[c for c in states.columns if c not in ("parent", "stage")])
    stages = states.groupBy("parent").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", state.alias("state"))))).alias("stages"))
    whole = pipeline_complete(jobs).select(F.col("parent").alias("of"), F.col("status").alias("whole"))
    parents = jobs.filter("parent_job_id is null").join(whole, F.col("id") == F.col("of"))
    return parents.join(stages, F.col("id") == F.col("parent"), "left").select("id", F.col("whole").alias("status"), "created_at", "stages")


def job_of_stage(jobs: DataFrame, parent: str, stage: str) -> DataFrame:
    """The first job of a parent's stage."""
    return jobs.filter((F.col("parent_job_id") == parent) & (F.col("stage") == stage)).orderBy("created_at", "id").limit(1)


def by_status(jobs: DataFrame, status: str, n: int = 100) -> DataFrame:
    return jobs.filter(F.col("status") == status).orderBy("created_at", "id").limit(n)


def pipeline_complete(jobs: DataFrame) -> DataFrame:
    """(parent, complete, status): complete if no child is open; the parent's state follows its children."""
    done = F.col("status").isin("COMPLETED", "FAILED")
    children = jobs.filter("parent_job_id is not null").groupBy(F.col("parent_job_id").alias("p")).agg(F.bool_and(done).alias("all_done"), F.max((F.col("status") == "FAILED").cast("int")).alias("failed"))
    parents = jobs.filter("parent_job_id is null").select(F.col("id").alias("parent"))
    complete = F.coalesce("all_done", F.lit(True))
    return parents.join(children, F.col("parent") == F.col("p"), "left").select(
        "parent", complete.alias("complete"), F.when(~complete, "PROCESSING").when(F.col("failed") == 1, "FAILED").otherwise("COMPLETED").alias("status")
    )


def retry_eligible(jobs: DataFrame) -> DataFrame:
    return jobs.filter((F.col("status") == "FAILED") & (F.col("retry_count") < F.col("max_retries")))


def retried(jobs: DataFrame) -> DataFrame:
    """The events that put failed jobs back into the queue."""
    return retry_eligible(jobs).withColumns({"status": F.lit("QUEUED"), "retry_count": F.col("retry_count") + 1, "error_message": F.lit(None).cast("string")})


def stale(jobs: DataFrame, before: str) -> DataFrame:
    """Finished jobs from before a time."""
    return jobs.filter(F.col("status").isin("COMPLETED", "FAILED") & (F.col("completed_at") < F.lit(before).cast("timestamp")))


def stale_days(jobs: DataFrame, days: int, now: str | None = None) -> DataFrame:
    """Finished jobs older than some days."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return jobs.filter(F.col("status").isin("COMPLETED", "FAILED") & (F.col("completed_at") < at - F.make_interval(days=F.lit(days))))


def purged(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """``jobs`` without those, and without the children of those, that go."""
    ids = gone.select("id").distinct()
    left = jobs.join(ids, "id", "left_anti")
    return left.join(ids.withColumnRenamed("id", "parent_job_id"), "parent_job_id", "left_anti").select(*jobs.columns)


def elapsed_ms(jobs: DataFrame) -> DataFrame:
    """(id, ms) from start to end; null while a job runs."""
    return jobs.select("id", (F.unix_millis("completed_at") - F.unix_millis("started_at")).alias("ms"))


def next_queued(jobs: DataFrame, n: int = 1) -> DataFrame:
    return jobs.filter("status = 'QUEUED'").orderBy("created_at", "id").limit(n)


def progressed(jobs: DataFrame, values: DataFrame, at: str) -> DataFrame:
    """Apply (id, progress): 100 completes a job, more than 0 starts it."""
    p = F.when(F.col("new_progress").isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), F.col("new_progress"))))
    time = F.lit(at).cast("timestamp")
    return jobs.join(values.select("id", F.col("progress").alias("new_progress")), "id", "left").withColumns({
        "progress": F.coalesce(p, "progress"),
        "status": F.when(p == 100, "COMPLETED").when(p > 0, "PROCESSING").otherwise(F.col("status")),
        "started_at": F.when((p > 0) & (p < 100), time).otherwise(F.col("started_at")),
        "completed_at": F.when(p == 100, time).otherwise(F.col("completed_at")),
    }).drop("new_progress")


def pipeline_events(documents: DataFrame, at: str, with_dedup: bool = True, base_delay=None) -> DataFrame:
    """Parent and stage jobs for each document (id, text, source, source_type).

    Extraction may start at once; later stages wait for a share of ``base_delay``, in
    seconds: a column of ``documents`` that follows what extraction took, or 6.
    """
    stages = [s for s in JOB_STAGES if with_dedup or s != "DEDUPLICATION"]
    time = F.lit(at).cast("timestamp")
    meta = F.to_json(F.struct("source", "source_type"))
    base = F.lit(6.0) if base_delay is None else base_delay
    parents = documents.select(
        F.concat(F.lit("job-"), "id").alias("id"), F.lit("PROCESS_KNOWLEDGE").alias("job_type"), F.lit(None).cast("string").alias("parent_job_id"), F.lit(None).cast("string").alias("stage"),
        "text", meta.alias("metadata"), F.lit("PROCESSING").alias("status"), time.alias("not_before"), base.alias("base"),
    )
    # children carry the parent's source, on which the later stages filter
    children = parents.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    kinds = F.create_map(*[F.lit(x) for s in stages for x in (s, STAGE_JOBS[s])])
    children = children.select(
        F.concat_ws("-", "id", F.lower("stage")).alias("id"), F.element_at(kinds, F.col("stage")).alias("job_type"), F.col("id").alias("parent_job_id"), "stage",
        F.when(F.col("stage") == "EXTRACTION", F.col("text")).alias("text"), "metadata", F.lit("QUEUED").alias("status"),
        (time + F.make_interval(secs=F.coalesce(stage_delay(F.col("stage"), F.col("base")), F.lit(0.0)).cast("decimal(8,6)"))).alias("not_before"),
    )
    return parents.drop("base").unionByName(children)
