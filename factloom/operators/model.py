"""Calls of a language model: retries, a circuit breaker, limits, parsing, salvage and usage.

A client is a callable ``client(prompt) -> (text, usage)``; nothing here knows a
service.  Extractors, which ``extract_triples`` runs in its tasks, are built from it.
"""

from __future__ import annotations

import copy
import json
import random
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from ..schema import TRIPLE_TYPES

Client = Callable[[str], tuple[str, dict]]

# What is worth another try: fixed values.
RETRY_CODES = ("ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN")
RETRY_STATUSES = (429, 500, 502, 503, 504)
RETRY_MESSAGES = ("rate limit", "timeout", "network", "connection", "temporarily unavailable")


class ModelError(Exception):
    """An answer that can't be used; ``text`` is what the model said, for salvage."""

    def __init__(self, kind: str, message: str, text: str | None = None):
        super().__init__(message)
        self.kind, self.text = kind, text

    def __reduce__(self):
        return ModelError, (self.kind, str(self), self.text)


def retryable(error: BaseException) -> bool:
    status = getattr(error, "status", None) or getattr(getattr(error, "response", None), "status", None)
    return getattr(error, "code", None) in RETRY_CODES or status in RETRY_STATUSES or any(m in str(error).lower() for m in RETRY_MESSAGES)


def delay(attempt: int, base: float, factor: float, most: float, jitter: float = 0.0) -> float:
    """Seconds before the next try; ``jitter`` from -1 to 1 moves it by a fifth at most."""
    return min(base * factor**attempt, most) * (1 + 0.2 * jitter)


def with_retry(call: Callable, retries: int = 2, base: float = 3.0, factor: float = 2.0, most: float = 15.0, jitter: bool = True, sleep: Callable[[float], None] = time.sleep):
    """The result of ``call``; errors that a later try may cure are tried again, others raised at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or not retryable(e):
                raise
            sleep(delay(attempt, base, factor, most, random.uniform(-1, 1) if jitter else 0.0))


@dataclass
class Breaker:
    """Opens after ``threshold`` failures in a row and lets one call try again after ``reset`` seconds."""

    threshold: int = 3
    reset: float = 120.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None

    def call(self, f: Callable):
        if self.opened is not None and self.clock() - self.opened < self.reset:
            raise ModelError("CIRCUIT_OPEN", "the circuit is open")
        try:
            out = f()
        except Exception:
            self.failures += 1
            if self.failures >= self.threshold:
                self.opened = self.clock()
            raise
        self.failures, self.opened = 0, None
        return out


class TokenBucket:
    """At most ``capacity`` calls at once and ``rate`` calls a second in the long run, first come, first served."""

    def __init__(self, capacity: float = 10, rate: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.capacity, self.rate, self.clock, self.sleep = capacity, rate, clock, sleep
        self.left, self.at, self.lock = capacity, clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:  # waiting inside keeps the order
            now = self.clock()
            self.left, self.at = min(self.capacity, self.left + (now - self.at) * self.rate), now
            if self.left < 1:
                self.sleep((1 - self.left) / self.rate)
                self.left, self.at = 1.0, self.clock()
            self.left -= 1


def wait_for_memory(used_mb: Callable[[], float], most_mb: float, tries: int = 30, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Wait until less than ``most_mb`` are in use; whether that came."""
    for _ in range(tries):
        if used_mb() < most_mb:
            return True
        sleep(pause)
    return used_mb() < most_mb


class Limits:
    """What one partition of a job may use: model calls at a time and in the long run, and memory."""

    def __init__(self, calls: int = 4, memory_mb: float | None = None, used_mb: Callable[[], float] | None = None, bucket: TokenBucket | None = None):
        self.slots, self.memory_mb, self.used_mb, self.bucket = threading.Semaphore(calls), memory_mb, used_mb, bucket or TokenBucket()

    def run(self, f: Callable):
        with self.slots:
            if self.memory_mb and self.used_mb and not wait_for_memory(self.used_mb, self.memory_mb):
                raise ModelError("MEMORY_LIMIT", "memory stays above the limit")
            self.bucket.take()
            return f()


def share_of(limits: dict, workers: int) -> dict:
    """One of ``workers`` equal shares of a job's limits; what is left of calls at a time goes unused, as a call can't be cut."""
    calls, capacity, rate = (limits.get(k, v) for k, v in (("calls", 4), ("capacity", 10.0), ("rate", 1.0)))
    if workers > calls:
        raise ValueError(f"{workers} workers can't share {calls} calls at a time")
    return {k: v for k, v in limits.items() if k not in ("calls", "capacity", "rate")} | {"calls": calls // workers, "bucket": TokenBucket(capacity / workers, rate / workers)}


# Names of token counts by generation of the interfaces, the first that is not 0 counts: fixed values.
USAGE_NAMES = {
    "input_tokens": ("inputTokens", "promptTokens", "prompt_tokens", "input_tokens"),
    "output_tokens": ("outputTokens", "completionTokens", "completion_tokens", "output_tokens"),
    "total_tokens": ("totalTokens", "total_tokens"),
    "thinking_tokens": ("thinkingTokens", "thinking_tokens"),
    "reasoning_tokens": ("reasoningTokens", "reasoning_tokens"),
}


def normal_usage(usage: dict | None) -> dict[str, int]:
    usage = usage or {}
    return {name: next((int(usage[k]) for k in names if usage.get(k)), 0) for name, names in USAGE_NAMES.items()}


def without_fence(text: str) -> str:
    return re.sub(r"^```(?:json)?\n?|```$", "", text.strip()).strip()


def _said(x) -> bool:
    return isinstance(x, str) and x.strip() != ""


def complete_items(items) -> list[dict]:
    """Items whose three parts are said."""
    return [t for t in items if isinstance(t, dict) and all(_said(t.get(k)) for k in ("subject", "predicate", "object"))] if isinstance(items, list) else []


def parse(text: str, field_name: str = "triples") -> list[dict]:
    """The items of an answer: blank ones are dropped, then one invalid item rejects the answer."""
    try:
        data = json.loads(without_fence(text))
    except ValueError as e:
        raise ModelError("PARSE_ERROR", f"no JSON: {e}", text) from e
    if not isinstance(data, dict) or not isinstance(data.get(field_name), list):
        raise ModelError("VALIDATION_ERROR", f"no list of {field_name}", text)
    items = complete_items(data[field_name])
    for t in items:
        c = t.get("confidence")
        if isinstance(c, bool) or not isinstance(c, (int, float)) or not 0 <= c <= 1:
            raise ModelError("VALIDATION_ERROR", f"confidence {c!r} is not from 0 to 1", text)
        if field_name == "relationships" and normal_type(t.get("relationship_type")) not in TRIPLE_TYPES:
            raise ModelError("VALIDATION_ERROR", f"unknown type {t.get('relationship_type')!r}", text)
    return items


def salvage(text: str | None, field_name: str = "triples") -> list[dict]:
    """What a rejected answer still holds: its complete items, without a confidence that is no number."""
    try:
        data = json.loads(without_fence(text or ""))
        return [t | {"confidence": c if isinstance(c := t.get("confidence"), (int, float)) and not isinstance(c, bool) else None} for t in complete_items(data.get(field_name))]
    except (ValueError, AttributeError):
        return []


def normal_type(name) -> str | None:
    return name.upper().replace("-", "_") if isinstance(name, str) else None


@dataclass
class Extracted:
    """What a chunk gave: triples (type, subject, predicate, object, confidence), errors (type, kind, message), usage."""

    triples: list[tuple] = field(default_factory=list)
    errors: list[tuple] = field(default_factory=list)
    usage: list[dict] = field(default_factory=list)


TYPE_HINTS = {
    "ENTITY_ENTITY": "relations between two entities",
    "ENTITY_EVENT": "entities that take part in events",
    "EVENT_EVENT": "events that precede, cause or follow each other",
    "EMOTIONAL_CONTEXT": "feelings of entities about something",
}


def type_prompt(text: str, kind: str) -> str:
    return f'List {TYPE_HINTS[kind]} in the text as JSON {{"triples": [{{"subject", "predicate", "object", "confidence"}}]}}.\n\n{text}'


def single_prompt(text: str, kinds: tuple[str, ...]) -> str:
    hints = "; ".join(f"{k}: {TYPE_HINTS[k]}" for k in kinds)
    return f'List relations in the text as JSON {{"relationships": [{{"subject", "predicate", "object", "relationship_type", "confidence"}}]}}, of these types: {hints}.\n\n{text}'


@dataclass
class ModelExtractor:
    """Extraction by a client: a call for each type (``four-stage``) or one for all (``single-pass``).

    A failing type leaves the others as they are; of an answer that is rejected, what
    can be used is salvaged.
    """

    client: Client
    method: str = "four-stage"
    retry: dict = field(default_factory=dict)
    model: str = "local"
    provider: str = "local"
    limits: dict | None = None

    def __post_init__(self):
        if self.method not in ("four-stage", "single-pass"):
            raise ValueError(f"method must be four-stage or single-pass, not {self.method}")
        self.breaker = self.limit = None

    def __getstate__(self):
        return self.__dict__ | {"breaker": None, "limit": None}  # each worker has its own

    @property
    def workers(self) -> int | None:
        """Over how many partitions a job's texts are dealt, each with its share of the limits; None without limits."""
        return None if self.limits is None else min(self.limits.get("workers", 4), self.limits.get("calls", 4))

    def in_partition(self) -> ModelExtractor:
        """This extractor with one partition's share of the job's limits, not used by any other."""
        out = copy.copy(self)
        out.breaker, out.limit = None, None
        if self.limits is not None:
            out.limit = Limits(**share_of({k: v for k, v in self.limits.items() if k != "workers"}, self.workers))
        return out

    def ask(self, prompt: str, field_name: str, out: Extracted, kind: str) -> list[dict]:
        self.breaker = self.breaker or Breaker()
        if self.limits is not None and self.limit is None:
            self.limit = self.in_partition().limit
        call = lambda: self.breaker.call(lambda: self.client(prompt))
        began = time.monotonic()
        try:
            text, usage = with_retry((lambda: self.limit.run(call)) if self.limit else call, **self.retry)
        except ModelError:
            raise
        except Exception as e:
            raise ModelError("AI_ERROR", str(e)) from e
        try:
            items = parse(text, field_name)
        except ModelError as e:
            out.errors.append((kind, e.kind, str(e)))
            return salvage(e.text, field_name)
        row = normal_usage(usage) | {"operation_type": "extraction", "relationship_type": kind, "model": self.model, "provider": self.provider}
        out.usage.append(row | {"duration_ms": round(1000 * (time.monotonic() - began))})
        return items

    def __call__(self, text: str, kinds: tuple[str, ...]) -> Extracted:
        out = Extracted()
        single = self.method == "single-pass"
        for kind in ("all",) if single else kinds:
            try:
                prompt = single_prompt(text, kinds) if single else type_prompt(text, kind)
                for t in self.ask(prompt, "relationships" if single else "triples", out, kind):
                    named = normal_type(t.get("relationship_type")) if single else kind
                    if named in kinds:
                        out.triples.append((named, t["subject"], t["predicate"], t["object"], t["confidence"]))
            except ModelError as e:
                out.errors.append((kind, e.kind, str(e)))
        return out
