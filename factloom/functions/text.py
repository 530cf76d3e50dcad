"""Text, id and date columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s ﻿]+|[\s ﻿]+$"


def trim_space(c: Column) -> Column:
    """Trim every white space; Spark's ``trim`` takes blanks only."""
    return F.regexp_replace(c, _EDGE, "")


# Control characters but tab and line ends: a fixed value.
_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def sanitize(c: Column, limit: int = 5000) -> Column:
    """Drop control characters but tab and line ends, trim, cut."""
    return F.substring(trim_space(F.regexp_replace(c, _CONTROLS, "")), 1, limit)


def clamp_confidence(c: Column) -> Column:
    """To [0, 1]; null and NaN become 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))))


def safe_id(*parts: Column) -> Column:
    """Base64 of the parts joined by ``|``, with signs outside letters and digits as ``_``.

    Not injective: join and deduplicate on the parts themselves.
    """
    return F.translate(F.base64(F.encode(F.concat_ws("|", *parts), "utf-8")), "+/=\r\n", "___")


def semantic_text() -> Column:
    return F.concat_ws(" ", "subject", "predicate", "object")


def search_terms(query: str) -> list[str]:
    """Blank-separated terms; a single term stands for the whole query as typed."""
    terms = query.split()
    return [query] if len(terms) == 1 else terms


def contains_any(columns: list[Column], terms: list[str]) -> Column:
    """Case-insensitive and literal; without terms nothing matches."""
    tests = [F.contains(F.lower(c), F.lit(t.lower())) for t in terms for c in columns]
    return reduce(or_, tests) if tests else F.lit(False)


# What is hidden in logs, in this order, and how: fixed values.
MASKS = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"sk-[a-zA-Z0-9]{48}", "[API_KEY]"),
    (r"eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*", "[JWT_TOKEN]"),
    (r"[a-f0-9]{64}", "[HASH_64]"),
    (r"[a-f0-9]{32}", "[HASH_32]"),
)


def mask(c: Column) -> Column:
    """Cut to 200 characters, as logs are, then tags for addresses, keys and digests."""
    cut = F.when(F.length(c) > 200, F.concat(F.substring(c, 1, 200), F.lit("..."))).otherwise(c)
    return reduce(lambda x, r: F.regexp_replace(x, F.lit(r[0]), F.lit(r[1])), MASKS, cut)


def mask_list(c: Column) -> Column:
    """An array of strings as struct<count, sample, truncated>: three masked items, and whether there are more."""
    return F.struct(F.size(c).alias("count"), F.transform(F.slice(c, 1, 3), mask).alias("sample"), (F.size(c) > 3).alias("truncated"))


def redact_map(c: Column) -> Column:
    """Values of keys that sound secret are hidden."""
    secret = lambda k: F.lower(k).rlike("embedding|password|secret|key|token")
    return F.transform_values(c, lambda k, v: F.when(secret(k), F.lit("[REDACTED]")).otherwise(v))


def strip_fences(c: Column) -> Column:
    """A model's JSON without the Markdown fence around it."""
    return trim_space(F.regexp_replace(trim_space(c), r"^```(?:json)?\s*|\s*```$", ""))


def listed(c: Column) -> Column:
    """Items as a prompt names them."""
    return F.array_join(c, ", ")


def word_window(c: Column, first: Column, n: Column) -> Column:
    """``n`` words from the ``first`` on (from 0), by single blanks."""
    return F.array_join(F.slice(F.split(c, r"\s+"), first + 1, n), " ")


def tail(c: Column, n: int = 5000) -> Column:
    """The last ``n`` characters."""
    return F.right(c, F.lit(n))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def model_name(c: Column) -> Column:
    """``provider/name`` as ``name``."""
    return F.element_at(F.split(c, "/"), -1)


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def window_bounds(value: int, unit: str, start: Column) -> tuple[Column, Column]:
    """[start - value units, start]; month arithmetic keeps to the month's last day."""
    back = {
        "days": lambda: start - F.make_interval(days=F.lit(value)),
        "weeks": lambda: start - F.make_interval(weeks=F.lit(value)),
        "months": lambda: start - F.make_interval(months=F.lit(value)),
        "years": lambda: start - F.make_interval(years=F.lit(value)),
    }[unit]()
    return back, start


def uptime(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` without leading zero parts."""
    s = seconds.cast("long")
    parts = [(F.floor(s / 86400), "d"), (F.floor(s % 86400 / 3600), "h"), (F.floor(s % 3600 / 60), "m")]
    shown = [F.when(n > 0, F.concat(n.cast("string"), F.lit(u))) for n, u in parts]
    return F.concat_ws(" ", *shown, F.concat((s % 60).cast("string"), F.lit("s")))
