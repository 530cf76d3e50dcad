"""Language identification, word first, with backoff to character n-grams.

Training counts words by language over a bounded sample of labelled rows:
about ``rows_per_language`` different rows of each language, the ones with the
smallest hashes of doc_id and text, all of them where there are fewer.  The model keeps every word of the sample
and every character n-gram of its words, of each length from ``longest`` to 1, so
its size follows the sample, not the corpus.

A text's score for a language is the sum over its words of log frequencies.  A
known word counts by itself.  An unseen word is covered from the left by its
longest known character n-grams: where none of the longest starts, shorter ones
are tried, down to single letters.

Null texts and texts without a letter get ``und`` with score 0; so does every
text when no row can be learned from.  Ties go to the alphabetically first
language, and so does a text of which the model knows nothing, with ``known`` 0.
Every row is judged by itself, also where doc_ids repeat or are missing (such a row
is not held out); equal rows (doc_id, text and lang) count once in the sample; the
time of a very long text follows its length.  An empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import IDS_SENT, few, written
from .workers import bounded_batches, lean

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> Counter:
    """Runs of letters; numbers such as halves and Roman ones are none."""
    found = Counter(_WORD.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


class Table:
    """Log frequencies by key: one row of a matrix for each key, one column for each language."""

    def __init__(self, by: dict[str, Counter], languages: list[str]):
        keys = sorted(set().union(*by.values())) if by else []
        self.at = {w: i for i, w in enumerate(keys)}
        counts = np.array([[by[k][w] for k in languages] for w in keys], float).reshape(len(keys), len(languages))
        totals = counts.sum(0) + 0.5 * len(keys) + 0.5
        self.logs = np.log((counts + 0.5) / totals).astype(np.float32)


class Model:
    def __init__(self, counts: dict[str, Counter], longest: int = 4):
        self.languages, self.longest = sorted(counts), longest
        self.words = Table(counts, self.languages)
        self.grams = []
        for n in range(1, longest + 1):
            by = {}
            for k, c in counts.items():
                g: Counter = Counter()
                for w, m in c.items():
                    padded = f"^{w}$" if n > 1 else w
                    for i in range(len(padded) - n + 1):
                        g[padded[i : i + n]] += m
                by[k] = g
            self.grams.append(Table(by, self.languages))
        self.unseen: dict[str, np.ndarray] = {}

    def backoff(self, w: str) -> tuple[np.ndarray, bool]:
        """Mean log frequency of the longest known n-grams that cover an unseen word from the left, and whether there is one."""
        padded, at, total, parts = f"^{w}$", 0, np.zeros(len(self.languages)), 0
        while at < len(padded):
            for n in range(min(self.longest, len(padded) - at), 0, -1):
                table = self.grams[n - 1]
                if (i := table.at.get(padded[at : at + n])) is not None:
                    total += table.logs[i]
                    parts += 1
                    at += n
                    break
            else:
                at += 1
        return total / max(parts, 1), parts > 0

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its score, and the share of the text's words of which the model knows something."""
        counts = words_of(text or "")
        if not counts or not self.languages:
            return UNKNOWN, 0.0, 0.0
        strange = 0
        at, rows, times, total, n = self.words.at, [], [], np.zeros(len(self.languages)), 0
        for w, m in counts.items():
            n += m
            if (i := at.get(w)) is not None:
                rows.append(i)
                times.append(m)
                continue
            if (one := self.unseen.get(w)) is None:
                if len(self.unseen) > 20_000:
                    self.unseen.clear()
                one = self.unseen[w] = self.backoff(w)
            total += m * one[0]
            strange += m * (not one[1])
        if rows:
            total += np.array(times, float) @ self.words.logs[rows]
        best = int(np.argmax(total))
        # words are weak evidence for each other, so that long texts don't all say 1.0
        return self.languages[best], float(1 / np.exp((total - total[best]) / math.sqrt(n)).sum()), 1 - strange / n


def held_out(doc_id, of: int, remainder: int):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def train(rows: DataFrame, rows_per_language: int = 1500, longest: int = 4) -> Model:
    """Fit on ``rows`` (doc_id, text, lang).  Counting is distributed; what comes back are the different words of the sample."""
    bounded_batches(rows.sparkSession)
    known = rows.filter("lang is not null and text is not null")
    # drawn by row: what rows share, such as an id or its absence, must not draw a whole language in or out
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = {r["lang"]: r for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.01).alias("n"), F.min(unit).alias("least")).collect()}
    # the row with the smallest hash is in whatever the share
    bound = F.create_map(*[F.lit(x) for k, r in sizes.items() for x in (k, max(r["least"], rows_per_language / max(r["n"], 1)))]) if sizes else None
    picked = known.filter(unit <= F.element_at(bound, F.col("lang"))).dropDuplicates(["doc_id", "text", "lang"]) if sizes else known

    def counted(tables):
        by: dict[str, Counter] = {}
        for t in tables:
            for lang, text in zip(t.column("lang").to_pylist(), t.column("text").to_pylist()):
                by.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in by.items():
            items = list(c.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w for w, _ in part]), pa.array([m for _, m in part], pa.int64())], ["lang", "word", "n"])

    counts = picked.select("lang", "text").mapInArrow(lean(counted), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    by: dict[str, Counter] = {}
    for lang, word, n in zip(*(found.column(c).to_pylist() for c in ("lang", "word", "n"))):
        by.setdefault(lang, Counter())[word] = n
    return Model(by, longest)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, known for each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judged(tables):
        m = sent.value
        for t in tables:
            found = [m.judge(x) for x in t.column("text").to_pylist()]
            said, score, known = zip(*found) if found else [()] * 3
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], ["doc_id", "lang_pred", "score", "known"])

    return docs.select("doc_id", "text").mapInArrow(lean(judged), "doc_id bigint, lang_pred string, score double, known double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known; learns from the rows that are not held out."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = train(docs.filter(~out).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "known")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a word, or an n-gram of one, that the model knows, with all their columns.

    Where rows share a doc_id, or have none, all of them go if one does.
    """
    verdicts = identify(docs.select("doc_id", "text", "lang")).select("doc_id", ((F.col("lang_pred") != UNKNOWN) & (F.col("known") > 0)).alias("kept"))
    by_id = written(verdicts, "languages").filter("not kept").select(F.col("doc_id").alias("__factloom_id")).distinct()
    return docs.join(F.broadcast(by_id) if few(by_id, IDS_SENT) else by_id, F.col("doc_id").eqNullSafe(F.col("__factloom_id")), "left_anti")
