"""Pipelines of jobs as keyed state: what is due, what is tried again, what follows.

One state for each pipeline holds its jobs by id.  Timers wake it when a job may start
(``not_before``, retries) and when one has run for too long.  No event is late: there is
no watermark, and an event of any age finds its pipeline's state.  An event that repeats
what the state knows changes nothing.

A call of the state, and a key with its batch of rows, cost many times what an event
does.  So the key is a slot of pipelines, whose states stand in pages: a micro-batch reads
and writes a page once for all events of its pipelines.  Events and rows come and go as
JSON, one column in place of one for each field; times in it are microseconds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.measures import STAGE_DELAYS
from ..operators.jobs import STAGE_JOBS

FINAL = ("COMPLETED", "FAILED", "CANCELLED")
SLOTS, PAGES = 2048, 16  # pages of a slot; a checkpoint holds for one number of each
FIELDS = (
    "id", "event_time", "job_type", "parent_job_id", "stage", "status", "progress", "retry_count", "max_retries", "text", "metadata", "result", "error_message", "not_before",
)
STATE = "pipeline string, kind string, " + ", ".join(
    f"{c} {'timestamp' if c in ('event_time', 'not_before') else 'int' if c in ('progress', 'retry_count', 'max_retries') else 'string'}" for c in FIELDS
)
OUT = "kind string, told string"
TOLD = Row("kind", "told")


@dataclass(frozen=True)
class Rules:
    """How jobs follow each other; times are in milliseconds.

    ``second``: how long a second of a delay takes, 0 where nothing should wait.
    """

    with_dedup: bool = True
    second: float = 1000.0
    backoff: float = 2000.0
    longest: float = 30_000.0
    timeout: float = 3_600_000.0

    def follow_ups(self) -> list[str]:
        return ["CONCEPTS"] + ["DEDUPLICATION"] * self.with_dedup

    def wait(self, stage: str, result: str | None) -> float:
        """A later stage's delay, from what extraction says it took and found."""
        said = json.loads(result or "{}")
        base = min(60, max(6, math.ceil((said.get("ms") or 0) / 1000), math.ceil((said.get("triples") or 0) / 10)))
        share, least = STAGE_DELAYS[stage]
        return max(least, base * share) * self.second

    def retry_wait(self, attempt: int) -> float:
        return min(self.backoff * 2**attempt, self.longest)


class Pipeline:
    """One pipeline's jobs by id (without fields that are null), and the next time at which a timer wakes it."""

    def __init__(self, name: str, rules: Rules, jobs: dict[str, dict], wake: int | None):
        self.name, self.rules, self.jobs, self.wake = name, rules, jobs, wake

    def next_wake(self) -> int | None:
        """When a timer is needed that is not there yet: at what is due first, unless one wakes the pipeline before."""
        at = min((j["due"] for j in self.jobs.values() if j["due"]), default=None)
        if at is None or self.wake is not None and self.wake <= at:
            return None
        self.wake = at
        return at

    def _put(self, job: dict, due: float) -> None:
        self.jobs[job["id"]] = job | {"due": math.ceil(due)}

    def _row(self, kind: str, job: dict, now: float) -> Row:
        told = {c: job[c] for c in FIELDS if c in job} | {"pipeline": self.name, "event_time": int(now * 1000)}
        return TOLD(kind, json.dumps(told))

    # -- transitions

    def _queue(self, job: dict, wait_until: float, now: float) -> Iterator[Row]:
        """The job waits, or runs at once if nothing is left to wait for."""
        job = job | {"status": "QUEUED"}
        if wait_until <= now:
            yield from self._start(job, now)
        else:
            self._put(job, wait_until)
            yield self._row("state", job, now)

    def _start(self, job: dict, now: float) -> Iterator[Row]:
        job = job | {"status": "PROCESSING"}
        self._put(job, now + max(self.rules.timeout, 1))  # a timer can't set itself again
        yield self._row("run", job, now)

    def _finish(self, job: dict, now: float) -> Iterator[Row]:
        """The job has come to an end: it is tried again, or what follows it is queued."""
        if job["status"] == "FAILED" and job.get("retry_count", 0) < job.get("max_retries", 0):
            attempt = job.get("retry_count", 0)
            yield from self._queue(job | {"retry_count": attempt + 1, "progress": 0}, now + self.rules.retry_wait(attempt), now)
            return
        self._put(job, 0)
        yield self._row("state", job, now)
        if job["status"] == "COMPLETED" and job.get("stage") == "EXTRACTION" and job.get("parent_job_id"):
            for stage in self.rules.follow_ups():
                of = f"{job['parent_job_id']}-{stage.lower()}"
                if of not in self.jobs:
                    at = now + self.rules.wait(stage, job.get("result"))
                    follow = {c: job[c] for c in ("parent_job_id", "metadata", "max_retries") if c in job} | {
                        "id": of, "job_type": STAGE_JOBS[stage], "stage": stage, "progress": 0, "retry_count": 0, "not_before": int(at * 1000),
                    }
                    yield from self._queue(follow, at, now)
        yield from self._close(now)

    def _close(self, now: float) -> Iterator[Row]:
        """The parent's state follows its children's, once all are final."""
        parent, children = self.jobs.get(self.name), [j for k, j in self.jobs.items() if k != self.name]
        if parent and parent.get("status") not in FINAL and children and all(j.get("status") in FINAL for j in children):
            parent = parent | {"status": "FAILED" if any(j["status"] == "FAILED" for j in children) else "COMPLETED", "progress": 100}
            self._put(parent, 0)
            yield self._row("state", parent, now)

    # -- what happens to it

    def event(self, told: dict, now: float) -> Iterator[Row]:
        job = self.jobs.get(told["id"])
        if told.get("status") == "QUEUED":
            if job is None:
                yield from self._queue(told, told.get("not_before", 0) / 1000, now)
        elif told.get("status") in FINAL:
            # an outcome counts for the attempt that runs; others are repetitions
            if job and job.get("status") == "PROCESSING" and told.get("retry_count", 0) == job.get("retry_count", 0):
                outcome = ("status", "progress", "result", "error_message")
                yield from self._finish({c: v for c, v in job.items() if c not in outcome} | {c: told[c] for c in outcome if c in told}, now)
        elif job is None:
            self._put(told, 0)
            yield self._row("state", told, now)
            yield from self._close(now)

    def expired(self, now: float) -> Iterator[Row]:
        if self.wake is not None and self.wake <= now:
            self.wake = None
        for job in list(self.jobs.values()):
            if not job["due"] or job["due"] > now:
                continue
            if job.get("status") == "QUEUED":
                yield from self._start(job, now)
            elif job.get("status") == "PROCESSING":
                yield from self._finish(job | {"status": "FAILED", "error_message": f"no outcome after {math.ceil(self.rules.timeout)} ms"}, now)


class Pipelines(StatefulProcessor):
    """Events in; what jobs have come to out, as ``run`` rows where they are to be worked on now and as ``state`` rows else."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "pipelines string")
        self.timers = handle.getMapState("timers", "at long", "pipelines string")  # whom a timer wakes

    def _each(self, names: Iterable[str], happens: Callable[[Pipeline], Iterator[Row]]) -> Iterator[Row]:
        """What happens to pipelines, with their states before and after, and the timers that they need then."""
        pages: dict[int, list[str]] = {}
        wakes: dict[int, list[str]] = {}
        for name in names:
            pages.setdefault(crc32(name.encode()) % PAGES, []).append(name)
        for page, here in pages.items():
            known = self.pages.getValue((page,))
            states = json.loads(known[0]) if known else {}
            for name in here:
                pipeline = Pipeline(name, self.rules, *states.get(name, ({}, None)))
                yield from happens(pipeline)
                if (at := pipeline.next_wake()) is not None:
                    wakes.setdefault(at, []).append(name)
                if pipeline.jobs:
                    states[name] = pipeline.jobs, pipeline.wake
            if (told := json.dumps(states)) != (known[0] if known else "{}"):
                self.pages.updateValue((page,), (told,))
        for at, woken in wakes.items():
            known = self.timers.getValue((at,))
            self.timers.updateValue((at,), (json.dumps((json.loads(known[0]) if known else []) + woken),))
            if known is None:
                self.handle.registerTimer(at)

    # -- what the stream calls

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, events = timerValues.getCurrentProcessingTimeInMs(), {}
        for row in rows:
            events.setdefault(row["pipeline"], []).append(json.loads(row["event"]))

        def happens(pipeline: Pipeline) -> Iterator[Row]:
            for told in sorted(events[pipeline.name], key=lambda e: ("event_time" not in e, e.get("event_time", 0), e["id"])):
                yield from pipeline.event({c: v for c, v in told.items() if c != "event_time"}, now)

        yield from self._each(events, happens)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = max(timerValues.getCurrentProcessingTimeInMs(), at)
        known = self.timers.getValue((at,))
        self.timers.removeKey((at,))
        yield from self._each(json.loads(known[0]) if known else [], lambda pipeline: pipeline.expired(now))

    def close(self) -> None:
        pass
