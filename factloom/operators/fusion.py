"""Weighted fusion of ranked search legs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TRIPLE_KEY

LEGS = ("entity", "relationship", "semantic", "concept")
WEIGHTS = {"entity": 0.3, "relationship": 0.2, "semantic": 0.3, "concept": 0.2}


#: Of the graph's text search, which leans on meaning.
TEXT_WEIGHTS = {"entity": 0.25, "relationship": 0.2, "semantic": 0.35, "concept": 0.2}


def leg_scores(ranked: DataFrame, leg: str, order: list) -> DataFrame:
    """(key, leg, pos, score): (n - position) / n over a leg of top-k size."""
    w = Window.orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    pos = F.row_number().over(w) - 1
    return ranked.select(*TRIPLE_KEY, F.lit(leg).alias("leg"), pos.alias("pos"), ((n - pos) / n).alias("leg_score"))


def fuse(legs: list[DataFrame], weights: dict[str, float] | None = None, limit: int = 10) -> DataFrame:
    """Weighted mean over the legs that found a key, with a bonus for several legs.

    A key that a leg found twice keeps its lower score.  Ties, to six digits, go to the
    first leg and position.
    """
    w = {**WEIGHTS, **(weights or {})}
    every = legs[0]
    for x in legs[1:]:
        every = every.unionByName(x)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(LEGS) for x in (k, i)])
    first = F.min(F.struct(F.element_at(order, F.col("leg")).alias("leg"), F.col("pos").alias("pos")))
    scores = [F.min(F.when(F.col("leg") == k, F.col("leg_score"))).alias(f"{k}_score") for k in LEGS]
    grouped = every.groupBy(*TRIPLE_KEY).agg(*scores, first.alias("first"))
    got = [F.col(f"{k}_score") for k in LEGS]
    total = sum((F.coalesce(c * w[k], F.lit(0.0)) for k, c in zip(LEGS, got)), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w[k]).otherwise(0.0) for k, c in zip(LEGS, got)), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in got), F.lit(0))
    bonus = 1 + 0.2 * F.log(1 + n) / math.log(5)
    return (
        grouped.withColumn("n_legs", n.cast("int"))
        .withColumn("fusion_score", F.try_divide(total, weight) * bonus)
        .orderBy(F.desc(F.round("fusion_score", 6)), "first.leg", "first.pos")  # the last bits of equal scores differ by weight
        .limit(limit)
        .drop("first")
    )
