"""Extraction, embedding and concept stages with deterministic local defaults.

The three functions can be replaced by ones that call a service; each is applied in
Arrow batches, embedding to distinct texts only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunks
from .model import Extracted
from .numbering import numbered

Extractor = Callable[[str, tuple[str, ...]], Extracted]
_SPAN = re.compile(r"[A-ZÀ-Þ][\w'-]*(?: [A-ZÀ-Þ][\w'-]*)*")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_BETWEEN_EVENTS = re.compile(r" (before|after|because|until|while) ")
_FEELS = re.compile(r"\b(feels|felt|is|was|seems|seemed) (happy|sad|angry|afraid|glad|proud|worried|excited|calm|passionate|anxious|grateful)\b")


def rule_extractor(text: str, kinds: tuple[str, ...]) -> Extracted:
    """The local default, by sentences, in one pass for all types.

    Between entities: the first and the last capitalised span, and the words between
    them.  Entity and event: a sentence with one such span, its next word, and the rest.
    Between events: what stands on both sides of a word such as "before".  Feelings: a
    span, a word such as "feels", and the feeling.
    """
    out = []
    for sentence in _SENTENCES.split(text):
        spans = list(_SPAN.finditer(sentence))
        told = sentence.rstrip(" .!?")
        if len(spans) > 1 and (verb := sentence[spans[0].end() : spans[-1].start()].strip(" ,.;:")):
            out.append(("ENTITY_ENTITY", spans[0][0], verb, spans[-1][0], round(min(1.0, 0.5 + len(verb) / 100), 2)))
        if spans and (m := _FEELS.search(sentence, spans[0].end())):
            out.append(("EMOTIONAL_CONTEXT", spans[0][0], m[1], m[2], 0.8))
        elif len(spans) == 1 and len(rest := told[spans[0].end() :].split(None, 1)) == 2:
            out.append(("ENTITY_EVENT", spans[0][0], rest[0], rest[1], 0.6))
        if m := _BETWEEN_EVENTS.search(told):
            if (one := told[: m.start()].strip(" ,;")) and (other := told[m.end() :].strip(" ,;")):
                out.append(("EVENT_EVENT", one, m[1], other, 0.5))
    return Extracted([t for t in out if t[0] in kinds])


def hash_embedder(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Signed feature hashing of words, of length 1."""
    out = np.zeros((len(texts), dimension))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
            out[i, h % dimension] += 1 if h >> 63 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


ROWS = (
    "row string, doc string, source string, source_type string, source_date timestamp, chunk int, type string, "
    "subject string, predicate string, object string, confidence double, error_type string, error string, usage string"
)
_ROWS = pa.schema([
    ("row", pa.string()), ("doc", pa.string()), ("source", pa.string()), ("source_type", pa.string()), ("source_date", pa.timestamp("us", "UTC")), ("chunk", pa.int32()), ("type", pa.string()),
    ("subject", pa.string()), ("predicate", pa.string()), ("object", pa.string()), ("confidence", pa.float64()), ("error_type", pa.string()), ("error", pa.string()), ("usage", pa.string()),
])


def extraction_rows(docs: DataFrame, types: tuple[str, ...], extractor: Extractor = rule_extractor, max_tokens: int = 3000, overlap: int = 200) -> DataFrame:
    """All that extraction says of docs (id, text, source, source_type, source_date), in one pass over the texts.

    ``row`` is one of: chunk (one for each, with an error if it gave nothing but one),
    triple, error (of a type), usage (of a call, as JSON, its type the call's number).  A chunk's source is its
    document's with the chunk's number.  Chunk failures leave the others as they are.
    An extractor with limits says over how many partitions (``workers``) its job's calls
    are dealt; each has its share of the limits, so that together they keep them.
    """
    n_types, workers = len(types), getattr(extractor, "workers", None)

    def run(tables) -> Iterator[pa.RecordBatch]:
        ask = extractor.in_partition() if workers else extractor
        for t in tables:
            for r in t.to_pylist():
                rows = []
                for i, (text, *_) in enumerate(chunks(r["text"], max_tokens, overlap)):
                    at = {"doc": r["id"], "source": f"{r['source']}_chunk_{i}", "source_type": r["source_type"], "source_date": r["source_date"], "chunk": i}
                    try:
                        got = ask(text, types)
                    except Exception as e:  # the others of the batch go on
                        got = Extracted(errors=[(k, "EXTRACTION_ERROR", str(e)) for k in types])
                    failed = len(got.errors) >= (n_types if got.errors and got.errors[0][0] != "all" else 1) and not got.triples
                    rows.append(at | {"row": "chunk"} | ({"error_type": got.errors[0][1], "error": got.errors[0][2]} if failed else {}))
                    rows += [at | dict(zip(("type", "subject", "predicate", "object", "confidence"), x)) | {"row": "triple"} for x in got.triples]
                    rows += [at | {"row": "error", "type": k, "error_type": e, "error": m} for k, e, m in got.errors]
                    rows += [at | {"row": "usage", "type": str(n), "usage": json.dumps(u)} for n, u in enumerate(got.usage)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROWS)

    lacks = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    given = docs.select(lacks("id", "string"), "text", "source", "source_type", lacks("source_date", "timestamp"))
    if workers:
        given = given.repartition(workers, F.pmod(F.xxhash64("id", "text", "source"), F.lit(1 << 20)))
    return given.mapInArrow(run, ROWS)


def extract_triples(docs: DataFrame, types: tuple[str, ...], extractor: Extractor = rule_extractor, max_tokens: int = 3000, overlap: int = 200) -> DataFrame:
    """The triples of docs, and a row with its error for each type that failed."""
    said = extraction_rows(docs, types, extractor, max_tokens, overlap).filter("row in ('triple', 'error')")
    return said.select("subject", "predicate", "object", "type", "source", "source_type", "source_date", "confidence", "error")


def chunk_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Chunks of extraction rows in all, and those that succeeded and failed."""
    failed = F.count_if(F.col("error").isNotNull())
    return rows.filter("row = 'chunk'").groupBy(*by).agg(F.count(F.lit(1)).alias("total_chunks"), F.count_if(F.col("error").isNull()).alias("successful_chunks"), failed.alias("failed_chunks"))


USAGE = "input_tokens int, output_tokens int, total_tokens int, thinking_tokens int, reasoning_tokens int, operation_type string, provider string, model string, duration_ms int"


def usage_rows(rows: DataFrame) -> DataFrame:
    """Token usage as said by the calls of extraction rows, each told by its document, chunk and number."""
    of = ["doc", "chunk", "source", "source_type"]
    return rows.filter("row = 'usage'").select(*of, F.col("type").alias("call"), F.from_json("usage", USAGE).alias("u")).select(*of, "call", "u.*")


def embed_texts(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hash_embedder) -> DataFrame:
    """(text, embedding) of the distinct texts."""
    return embed_distinct(texts.filter("text is not null").select("text").distinct(), embedder)


def embed_distinct(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hash_embedder) -> DataFrame:
    """(text, embedding) of texts that are distinct and not null."""

    def run(tables) -> Iterator[pa.RecordBatch]:
        for t in tables:
            vectors = embedder(t.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([t.column("text"), pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))], ["text", "embedding"])

    return texts.select("text").mapInArrow(run, "text string, embedding array<float>")


def bucket_concepts(elements: DataFrame, *by: str) -> DataFrame:
    """Default concept stage over (kind, text) of each group: the last word names it, its frequency sets the level."""
    named = elements.withColumn("concept", F.lower(F.element_at(F.split("text", " "), -1)))
    n = named.groupBy(*by, "concept").agg(F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("n") >= 10, "HIGH").when(F.col("n") >= 3, "MEDIUM").otherwise("LOW")
    return named.join(n, [*by, "concept"]).select(*by, F.col("text").alias("source_element"), "kind", "concept", level.alias("abstraction_level"))


def concept_prompt(sets: DataFrame, *by: str, most: int = 1_000) -> DataFrame:
    """Prompts for each group of distinct (kind, text), for a stage that asks a model, numbered by ``part`` from 0.

    A prompt lists at most ``most`` elements of a kind, in order; a group with more of one has several prompts.
    """
    placed = numbered(sets.select(*by, "kind", "text").filter("text is not null"), [*by, "kind"], ["text"])
    cut = placed.withColumn("part", F.floor(F.col("place") / most).cast("int"))
    of = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("text")))), ", ")
    lists = cut.groupBy(*by, "part").agg(*[of(k).alias(k) for k in ("entity", "event", "relationship")])
    prompt = F.format_string("Name concepts for these elements.\nEntities: %s\nEvents: %s\nRelationships: %s", "entity", "event", "relationship")
    return lists.select(*by, "part", prompt.alias("prompt"))
