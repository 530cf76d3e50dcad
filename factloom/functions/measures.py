"""Arithmetic of costs, delays, retries and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_nonzero(*columns: Column) -> Column:
    """The first that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in columns], F.lit(0))


def usage_cost(price_in: Column, price_out: Column, price_thinking: Column, price_reasoning: Column) -> Column:
    """Prices for 1000 tokens; thinking and reasoning are billed only where both are used."""
    both = (F.coalesce("thinking_tokens", F.lit(0)) != 0) & (F.coalesce("reasoning_tokens", F.lit(0)) != 0)
    base = F.col("input_tokens") / 1000 * price_in + F.col("output_tokens") / 1000 * price_out
    more = F.col("thinking_tokens") / 1000 * price_thinking + F.col("reasoning_tokens") / 1000 * price_reasoning
    return base + F.when(both, more).otherwise(0.0)


def processing_delay(duration_ms: Column, n_items: Column) -> Column:
    """Seconds before the next stage: 6 to 60."""
    return F.least(F.lit(60), F.greatest(F.lit(6), F.ceil(duration_ms / 1000), F.ceil(n_items / 10))).cast("long")


#: Of a later stage: the share of the base delay, and the least seconds.  Fixed values.
STAGE_DELAYS = {"CONCEPTS": (0.1, 6.0), "DEDUPLICATION": (0.2, 10.0)}


def stage_delay(stage: Column, base: Column) -> Column:
    """Seconds that a stage waits after extraction; null for other stages."""
    out = F.lit(None).cast("double")
    for name, (share, least) in STAGE_DELAYS.items():
        out = F.when(stage == name, F.greatest(F.lit(least), base * share)).otherwise(out)
    return out


def batch_number(place: Column, size: int) -> Column:
    """The batch of the item at ``place`` (from 0)."""
    return F.floor(place / size).cast("int")


def backoff(base: float, factor: float, attempt: Column, most: float, jitter: Column | None = None) -> Column:
    delay = F.least(F.lit(base) * F.pow(F.lit(factor), attempt), F.lit(most))
    return delay if jitter is None else delay * (1 + 0.2 * (2 * jitter - 1))


def progress(value: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), value))


def chunk_progress(done: Column, total: Column) -> Column:
    return F.round(10 + done / total * 70).cast("int")


def rate(amount: Column, per: Column, scale: float = 1.0) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(amount * scale, per)
