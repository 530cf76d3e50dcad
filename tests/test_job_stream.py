"""The stream of jobs: schedules, follow-ups, retries, time-outs, repetitions and late events."""

import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from factloom.operators import jobs
from factloom.streaming import job_state, job_stream
from factloom.streaming.job_state import Rules

DOCS = "id string, text string, source string, source_type string"


def pipeline(spark, name, at="2025-01-01 00:00:00", text="x"):
    """A parent and its extraction job, as a request begins."""
    docs = spark.createDataFrame([(name, text, f"src-{name}", "file")], DOCS)
    events = jobs.pipeline_events(docs, at, with_dedup=False).filter("stage is null or stage = 'EXTRACTION'")
    return events.withColumns({"event_time": F.lit(at).cast("timestamp"), "retry_count": F.lit(0), "max_retries": F.lit(2)})


def counting(seen, outcome):
    """A handler that notes what it was given and says what came of it."""

    def handle(batch):
        seen.extend((r["id"], r["retry_count"], time.time()) for r in batch.select("id", "retry_count").collect())
        return batch.withColumns(outcome(batch))

    return handle


def done(result="{}"):
    return lambda batch: {"status": F.lit("COMPLETED"), "progress": F.lit(100), "result": F.lit(result)}


def test_stages_follow_after_their_delays(spark, tmp_path):
    where, out = f"{tmp_path}/events", f"{tmp_path}/done"
    seen, ran = [], {}
    said = json.dumps({"triples": 400, "ms": 100})  # 40 seconds: concepts wait 6, dedup 10, at the least
    handlers = {
        "EXTRACT_KNOWLEDGE_BATCH": counting(seen, done(said)), "GENERATE_CONCEPTS": counting(seen, done()), "DEDUPLICATE_KNOWLEDGE": counting(seen, done()),
    }
    old = (datetime.now() - timedelta(hours=2)).strftime("%Y-%m-%d %H:%M:%S")
    job_stream.enqueue(spark, where, pipeline(spark, "now"))
    odd = pipeline(spark, "odd").filter("stage is not null").withColumns({"id": F.lit("odd"), "parent_job_id": F.lit(None).cast("string"), "job_type": F.lit("OTHER"), "max_retries": F.lit(0)})
    job_stream.enqueue(spark, where, odd)
    query = job_stream.run_jobs(spark, where, out, f"{tmp_path}/state", handlers, Rules(second=400), every="200 milliseconds")
    while not any(i == "job-now-extraction" for i, *_ in seen):
        assert not query.exception()
        time.sleep(0.2)
    job_stream.enqueue(spark, where, pipeline(spark, "now"))  # repeated
    job_stream.enqueue(spark, where, pipeline(spark, "late", old))  # two hours older than what has been seen
    job_stream.wait_until_final(query, spark, out, 9, 120)
    states = {r["id"]: r for r in job_stream.job_states(spark, out).collect()}
    assert {k: r["status"] for k, r in states.items()} == {f"job-{n}{s}": "COMPLETED" for n in ("now", "late") for s in ("", "-extraction", "-concepts", "-deduplication")} | {"odd": "FAILED"}
    assert states["odd"]["error_message"] == "no handler for OTHER"
    assert sorted(i for i, *_ in seen) == sorted(k for k in states if k.count("-") == 2)  # each once
    ran = {i: at for i, _, at in seen}
    for n in ("now", "late"):
        assert ran[f"job-{n}-concepts"] - ran[f"job-{n}-extraction"] >= 0.1 * 40 * 0.4 and ran[f"job-{n}-deduplication"] - ran[f"job-{n}-extraction"] >= 10 * 0.4
    follow = states["job-late-concepts"]
    assert follow["parent_job_id"] == "job-late" and json.loads(follow["metadata"])["source"] == "src-late"  # the parent's source goes along


def test_retries_and_a_restart(spark, tmp_path):
    where, out = f"{tmp_path}/events", f"{tmp_path}/done"
    seen = []

    def flaky(batch):  # the first two attempts of "a" fail, all of "b"
        ok = (F.col("id") == "job-a-extraction") & (F.col("retry_count") >= 2)
        return {"status": F.when(ok, "COMPLETED").otherwise("FAILED"), "progress": F.lit(0), "error_message": F.when(~ok, "no answer")}

    handlers = {"EXTRACT_KNOWLEDGE_BATCH": counting(seen, flaky), "GENERATE_CONCEPTS": counting(seen, done())}
    rules = Rules(with_dedup=False, second=0, backoff=100)
    job_stream.enqueue(spark, where, pipeline(spark, "a").unionByName(pipeline(spark, "b")))
    query = job_stream.run_jobs(spark, where, out, f"{tmp_path}/state", handlers, rules, every="100 milliseconds")
    while len(seen) < 2:
        assert not query.exception()
        time.sleep(0.1)
    query.stop()
    query = job_stream.run_jobs(spark, where, out, f"{tmp_path}/state", handlers, rules, every="100 milliseconds")
    job_stream.wait_until_final(query, spark, out, 5, 120)
    states = {r["id"]: (r["status"], r["retry_count"]) for r in job_stream.job_states(spark, out).collect()}
    assert states == {"job-a": ("COMPLETED", 0), "job-a-extraction": ("COMPLETED", 2), "job-a-concepts": ("COMPLETED", 0), "job-b": ("FAILED", 0), "job-b-extraction": ("FAILED", 2)}
    assert {n for i, n, _ in seen if i == "job-b-extraction"} == {0, 1, 2}


def test_a_job_without_outcome_times_out(spark, tmp_path):
    where, out = f"{tmp_path}/events", f"{tmp_path}/done"
    handlers = {"EXTRACT_KNOWLEDGE_BATCH": lambda batch: batch.limit(0)}  # says nothing
    job_stream.enqueue(spark, where, pipeline(spark, "a").withColumn("max_retries", F.lit(0)))
    query = job_stream.run_jobs(spark, where, out, f"{tmp_path}/state", handlers, Rules(second=0, timeout=500), every="100 milliseconds")
    job_stream.wait_until_final(query, spark, out, 2, 120)
    states = {r["id"]: r for r in job_stream.job_states(spark, out).collect()}
    assert states["job-a"]["status"] == "FAILED" and states["job-a-extraction"]["error_message"] == "no outcome after 500 ms"


def test_a_raising_handler_stops_the_stream(spark, tmp_path):
    def broken(batch):
        raise RuntimeError("stage cancelled")

    job_stream.enqueue(spark, f"{tmp_path}/events", pipeline(spark, "a"))
    query = job_stream.run_jobs(spark, f"{tmp_path}/events", f"{tmp_path}/done", f"{tmp_path}/state", {"EXTRACT_KNOWLEDGE_BATCH": broken}, Rules(), every="100 milliseconds")
    with pytest.raises(Exception, match="stage cancelled"):
        query.awaitTermination(60)
    assert os.path.isdir(f"{tmp_path}/done")


class Counted:
    """A key's state and timers, with the calls of them."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getMapState(self, name, key, value):
        return CountedMap(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)


class CountedMap:
    def __init__(self, of):
        self.of, self.held = of, {}

    def getValue(self, key):
        self.of.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.of.calls += 1
        self.held[key] = value

    def removeKey(self, key):
        self.of.calls += 1
        self.held.pop(key, None)


def test_many_pipelines_take_few_calls_of_the_state():
    asked = lambda n, at: json.dumps({"id": f"job-{n}-extraction", "parent_job_id": f"job-{n}", "stage": "EXTRACTION", "status": "QUEUED", "not_before": at * 1000})
    rows = [Row(pipeline=f"job-{n}", event=asked(n, 0 if n else 7000)) for n in range(1000)]
    handle, state = Counted(), job_state.Pipelines(Rules(timeout=2000, second=0))
    state.init(handle)
    out = list(state.handleInputRows((0,), iter(rows), TimerValues(5000, 0)))
    assert sum(r["kind"] == "run" for r in out) == 999 and sum(r["kind"] == "state" for r in out) == 1
    assert handle.calls <= 2 * job_state.PAGES + 10 and sorted(handle.timers) == [7000]  # one time for both: job-0 may start, the others time out
    outcome = json.dumps({"id": "job-1-extraction", "status": "COMPLETED"})
    assert [json.loads(r["told"])["id"] for r in state.handleInputRows((0,), iter([Row(pipeline="job-1", event=outcome)]), TimerValues(6000, 0))] == ["job-1-extraction", "job-1-concepts", "job-1-deduplication"]
    handle.calls = 0
    out = [json.loads(r["told"]) | {"kind": r["kind"]} for r in state.handleExpiredTimer((0,), TimerValues(7000, 0), ExpiredTimerInfo(7000))]
    assert {r["status"] for r in out if r["id"] != "job-0-extraction"} == {"FAILED"} and len(out) == 999  # job-1 ended in time
    assert [r["kind"] for r in out if r["id"] == "job-0-extraction"] == ["run"]
    assert handle.calls <= 2 * job_state.PAGES + 10 and sorted(set(handle.timers)) == [7000, 8000, 9000]  # job-1's later stages, job-0


class Told:
    """A stream that tells another progress each time."""

    def __init__(self, *progress):
        self.left, self.stopped = list(progress), False

    def exception(self):
        return None

    @property
    def recentProgress(self):
        return self.left.pop(0) if len(self.left) > 1 else self.left[0]

    def stop(self):
        self.stopped = True


def test_waiting_reads_each_batch_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job_stream, "job_states", lambda *_: pytest.fail("all batches are read again"))
    for n, states in enumerate((["COMPLETED", "PROCESSING"], ["FAILED"], ["COMPLETED"])):
        spark.createDataFrame([(f"{n}-{i}", s) for i, s in enumerate(states)], "id string, status string").write.parquet(f"{tmp_path}/batch={n}")
    ran, idle = (lambda n: {"batchId": n, "durationMs": {"addBatch": 1}}), (lambda n: {"batchId": n, "durationMs": {}})
    query = Told([], [ran(0)], [ran(0)], [ran(0), ran(1)])
    job_stream.wait_until_final(query, spark, str(tmp_path), 2, 60)
    assert query.stopped
    with pytest.raises(TimeoutError):
        job_stream.wait_until_final(Told([ran(1), idle(2)]), spark, str(tmp_path), 3, 3)  # batch 2 has not ended
