"""Splitting long texts into overlapping chunks at paragraphs and sentences."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = "array<struct<text:string,estimated_tokens:int,start:int,end:int>>"


def estimate(text: str) -> int:
    return -(-len(text) // 4)


def _units(text: str, most: int):
    """(unit, what joins it to the text before it, what the joint counts, where its paragraph began), or None where a chunk ends.

    Units are paragraphs, or the sentences of a longer one, before which a chunk ends.
    """
    processed = 0
    for i, p in enumerate(p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()):
        extra = 2 * (i > 0)
        if len(p) <= most:
            yield p, "\n\n", extra, processed
        else:
            yield None
            for s in re.split(r"\. (?=[A-Z])", p):
                yield s if s.endswith(".") else s + ".", " ", 0, None
        processed += len(p) + extra


def chunks(text: str | None, max_tokens: int = 3000, overlap_tokens: int = 200) -> list[tuple[str, int, int, int]]:
    """(text, estimated tokens, start, end) of each chunk.

    A chunk begins with the end of the one before it and may exceed the limit by that
    and one unit; start and end are approximate.
    """
    if not text or not text.strip():
        return []
    if estimate(text) <= max_tokens:
        return [(text.strip(), estimate(text), 0, len(text))]
    most, overlap = 4 * max_tokens, 4 * overlap_tokens
    out: list[tuple[str, int, int, int]] = []
    now, start = "", 0

    def closed() -> bool:
        nonlocal now, start
        if not (done := now.strip()):
            return False
        out.append((done, estimate(done), start, start + len(done)))
        back = max(0, len(done) - overlap)
        now, start = done[back:], start + back
        return True

    for unit in _units(text, most):
        if unit is None:
            closed()
            continue
        said, joint, extra, began = unit
        if len(now) + extra + len(said) > most and not closed() and began is not None:
            now, start = "", began
        now += (joint if now else "") + said
    if now.strip():
        closed()
    return out


def chunk_column(text: Column, max_tokens: int = 3000, overlap_tokens: int = 200) -> Column:
    """array<struct<text, estimated_tokens, start, end>> for ``posexplode``.

    Row by row: Spark sends a plain function some hundred texts at a time, where an Arrow
    batch is ten thousand, of any length, beside all of their chunks.
    """
    return F.udf(lambda t: chunks(t, max_tokens, overlap_tokens), CHUNK, useArrow=False)(text)
