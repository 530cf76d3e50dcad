"""Fill-in-middle: documents cut in three and put together so that the middle comes last.

Arrow batches reach a pandas UDF.  A text's units are words with the white space before
them; their end offsets, in code points, go into a compact array, so that where the cuts
lie costs two look-ups.  A digest of (seed, doc_id) decides everything, so reruns agree
whatever the partitions, and rows that share a doc_id are drawn alike.

Null text is empty; an empty text, one that holds a sentinel, and the share that the rate
leaves alone stay plain.  A row without doc_id is drawn by the seed alone.  Texts of white
space alone are one unit.  Other columns go along; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import bounded_batches, give_back

# The contract's patterns and signs, fixed values.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

FIM = "n long, form string, prefix_chars long, middle_chars long, output string"


def seeds(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits, drawn from a document's identifier."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else int(doc_id)}".encode()).hexdigest()
    return [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(text: str, pattern: regex.Pattern) -> array:
    """The offset after each unit, preceded by 0."""
    return array("Q", [0]) + array("Q", (m.end() for m in pattern.finditer(text)))


def transformed(text: str | None, doc_id: int | None, seed: int, rate: int, spm_rate: int, pattern: regex.Pattern) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    text = text or ""
    ends = unit_ends(text, pattern)
    n = len(ends) - 1
    h1, h2, h3, h4 = seeds(seed, doc_id)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[first], ends[second]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made of: its parts lie between sentinels, which the text itself does not hold."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return two + middle + one if form == "spm" else one + middle + two


def transform_column(doc_id: Column, text: Column, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> Column:
    """A struct as FIM says; ``rate`` and ``spm_rate`` are percentages of documents and of those in suffix-first form."""

    @F.pandas_udf(FIM)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(UNIT)
        try:
            for ids, texts in batches:
                rows = [transformed(t, None if i is None or i != i else i, seed, rate, spm_rate, pattern) for i, t in zip(ids, texts)]
                out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
                yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        finally:
            give_back()

    # as text: a column of whole numbers with nulls would reach pandas as floats
    return run(doc_id.cast("string"), text)


def digest_columns(output: Column, form: Column) -> Column:
    """SHA-256 of outputs, and of the texts rebuilt from outputs and forms alone."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for outputs, forms in batches:
            yield pd.DataFrame({"output_sha256": [hexed(o) for o in outputs], "restored_sha256": [hexed(restored(o, f)) for o, f in zip(outputs, forms)]})

    return run(output, form)


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, into: str = "fim") -> DataFrame:
    """``docs`` (doc_id, text) with the struct ``into``: n, form, prefix_chars, middle_chars, output."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(into, transform_column(F.col("doc_id"), F.col("text"), seed, rate, spm_rate))
