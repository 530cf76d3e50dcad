"""A training corpus from ``documents``: language, exact and near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on; all
but the last return the columns of ``documents``.

Odd rows are as the operators say: texts without a letter, null ones among them, go
first; rows that share a doc_id, or have none, are told apart where an operator
decides by row; other columns go along, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, jaccard_join, language, mixing, packing
from factloom.llm.queries import word_vocabulary
from factloom.llm.scratch import documents, written

#: Tokenizing, random mixing and similarity have no SQL form; a test compares run() with a chain of plain loops.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a word or n-gram that the model knows, go."""
    return language.identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity links stays."""
    return jaccard_join.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes twice come twice."""
    return mixing.mixed(docs, total_share=1.5, cap=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_vocabulary(), end_id=1, capacity=4096)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
