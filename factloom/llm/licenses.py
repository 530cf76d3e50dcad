"""License scans by diagonal voting.

Words are runs of a-z, 0-9 and everything beyond ASCII after lower-casing A-Z.
Base labels stand for places where a phrase's words follow each other; they are
counted on the words joined by double blanks, so that neighbouring places don't
share a blank.

The method: every rolling k-gram of words of every text is hashed and joined to
the positions of the templates' k-grams (a constant table of a few hundred rows,
so the join needs no shuffle; a bitmap of its hashes keeps nearly all other k-grams
from becoming rows first).  A match is verified by comparing all its words, and
votes for the diagonal "position in text minus position in template".  Votes are
gathered by row, template and diagonal, as the set of the template's positions;
diagonals that lie within ``gap`` of each other are merged, so that a few words
more or less don't split a span; a span's score is the share of the template's
positions that it covers.  A template's label holds from ``least`` on.

Null and empty texts have no words and no labels, with score 0.  Each row has
votes of its own, by 128 bits of its doc_id and text; rows equal in both have equal
results, as positions count once.  A row without doc_id is one like any other.  Of
a very long text a task holds the words and a copy of them, in pieces of
``PIECE`` words, whose k-grams it lists piece by piece.  An empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 4
PIECE = 4096
BITS = 1 << 14  # of the templates' bitmap
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Openings of public licence notices, fixed values.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}


def spaced_words(text: Column) -> Column:
    """Words with one blank before and after each: `` a  b  c ``; empty for no words."""
    # lower() also changes letters beyond ASCII, all of them to letters beyond ASCII but for
    # the Kelvin sign, which a private character stands for
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")))
    joined = F.trim(F.regexp_replace(lowered, NOT_WORDS, "  "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _n_words(spaced: Column) -> Column:
    blanks = F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))
    return (blanks / 2).cast("long")


def base_columns(spaced: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and the base labels' array."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        mark = "".join(f" {w} " for w in words)
        has = F.contains(spaced, F.lit(mark))
        n = (F.length(spaced) - F.length(F.replace(spaced, F.lit(mark), F.lit("")))) / len(mark)
        counts.append(F.when(has, n.cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(has, _n_words(F.substring_index(spaced, mark, 1))))
        lasts.append(F.when(has, _n_words(spaced) - _n_words(F.substring_index(spaced, mark, -1)) - len(words)))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_words": _n_words(spaced),
        "n_base": sum(counts[1:], counts[0]),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "base": F.array_compact(F.array(*labels)),
    }


def template_words(text: str) -> list[str]:
    return re.sub(NOT_WORDS, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def template_grams(spark: SparkSession, templates=None) -> DataFrame:
    """(t_gram, t_words, template, label, t_pos, t_grams): a constant table."""
    rows = []
    for label, texts in (templates or TEMPLATES).items():
        for i, text in enumerate(texts):
            words = template_words(text)
            n = len(words) - K + 1
            rows += [(words[j : j + K], f"{label}/{i}", label, j, n) for j in range(n)]
    table = spark.createDataFrame(rows, "t_words array<string>, template string, label string, t_pos int, t_grams int")
    return table.select(F.xxhash64("t_words").alias("t_gram"), "t_words", "template", "label", "t_pos", "t_grams")


def _hash(words: Column, at: Column) -> Column:
    """That of the k words from ``at`` on, as of an array of them."""
    return F.xxhash64(*[F.element_at(words, (at + j).cast("int")) for j in range(K)])


def may_match(grams: DataFrame):
    """A test of hashes: false for all but the templates' ones and those that share a bit with one."""
    words = [0] * (BITS // 64)
    for r in grams.select("t_gram").distinct().collect():  # a few hundred rows
        at = r["t_gram"] % BITS
        words[at // 64] |= 1 << at % 64
    bitmap = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in words])

    def test(h: Column) -> Column:
        at = F.pmod(h, F.lit(BITS))
        return F.call_function("shiftrightunsigned", F.get(bitmap, F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def row_key() -> list[Column]:
    """128 bits of a row's doc_id and text, as two numbers."""
    return [F.xxhash64("doc_id", "text", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2")]


def votes(docs: DataFrame, templates=None) -> DataFrame:
    """(k1, k2, template, label, t_grams, diagonal, t_pos, pos): verified k-gram matches; positions count from 1."""
    words = F.split(F.trim(spaced_words(F.col("text"))), "  ")
    split = docs.select(*row_key(), words.alias("w")).filter(F.size("w") >= K)
    starts = F.sequence(F.lit(1), F.size("w") - (K - 1), F.lit(PIECE))
    piece = lambda i: F.struct(i.alias("first"), F.slice("w", i, F.lit(PIECE + K - 1)).alias("w"))
    pieces = split.select("k1", "k2", F.explode(F.transform(starts, piece)).alias("p")).select("k1", "k2", "p.*")
    of_templates = template_grams(docs.sparkSession, templates)
    may = may_match(of_templates)
    hashed = lambda i: F.struct(i.alias("at"), _hash(F.col("w"), i).alias("h"))
    some = F.filter(F.transform(F.sequence(F.lit(1), F.size("w") - (K - 1)), hashed), lambda x: may(x["h"]))
    gram = lambda x: F.struct((F.col("first") + x["at"] - 1).alias("pos"), F.slice("w", x["at"], F.lit(K)).alias("words"))
    grams = pieces.select("k1", "k2", F.explode(F.transform(some, gram)).alias("g")).select("k1", "k2", "g.*")
    # equal hashes alone don't count
    same = (F.xxhash64("words") == F.col("t_gram")) & (F.col("words") == F.col("t_words"))
    hits = grams.join(F.broadcast(of_templates), same)
    return hits.select("k1", "k2", "template", "label", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal"), "t_pos", "pos")


def spans(docs: DataFrame, gap: int = 3, templates=None) -> DataFrame:
    """(k1, k2, label, template, first_pos, last_pos, score): merged, verified spans; words count from 0."""
    diagonals = votes(docs, templates).groupBy("k1", "k2", "template", "label", "t_grams", "diagonal").agg(
        F.collect_set("t_pos").alias("at"), F.min("pos").alias("lo"), F.max("pos").alias("hi")  # at most t_grams positions
    )
    w = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    merged = (
        diagonals.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(w) > gap).cast("int"))
        .withColumn("area", F.sum(F.coalesce("new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select("k1", "k2", "template", "label", "t_grams", "area", "lo", "hi", F.explode("at").alias("t_pos"))
        .groupBy("k1", "k2", "template", "label", "t_grams", "area")
        .agg(F.size(F.collect_set("t_pos")).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    return merged.select("k1", "k2", "label", "template", (F.col("lo") - 1).alias("first_pos"), (F.col("hi") + K - 2).alias("last_pos"), (F.col("n") / F.col("t_grams")).alias("score"))


def scan(docs: DataFrame, least: float = 0.6, templates=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spaced = docs.select("doc_id", *row_key(), spaced_words(F.col("text")).alias("s"))
    base = spaced.select("doc_id", "k1", "k2", *[c.alias(k) for k, c in base_columns(F.col("s")).items()])
    found = spans(docs, templates=templates).groupBy("k1", "k2").agg(
        F.collect_set(F.when(F.col("score") >= least, F.col("label"))).alias("more"), F.max("score").alias("best")
    )
    joined = base.join(found, ["k1", "k2"], "left")
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
