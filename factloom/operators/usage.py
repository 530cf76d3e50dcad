"""Token usage and benchmark analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import usage_cost
from ..functions.text import model_name


def usage_summary(usage: DataFrame) -> DataFrame:
    """Totals, by operation and by provider, in one pass with grouping sets."""
    level = F.expr("case grouping_id(operation_type, provider) when 3 then 'total' when 1 then 'operation' else 'provider' end")
    return usage.groupingSets([[], [F.col("operation_type")], [F.col("provider")]], "operation_type", "provider").agg(
        level.alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"), F.sum("duration_ms").alias("duration_ms"),
    )


def usage_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` with cost by model, whose provider prefix doesn't count; unknown models have none."""
    priced = usage.withColumn("price_model", model_name(F.col("model"))).join(F.broadcast(prices), "price_model", "left")  # one row for each model
    return priced.withColumn("cost", usage_cost(F.col("price_in"), F.col("price_out"), F.col("price_thinking"), F.col("price_reasoning")))


def latency_stats(calls: DataFrame, *by: str) -> DataFrame:
    n = F.count(F.lit(1))
    return calls.groupBy(*by).agg(
        n.alias("calls"), F.avg("duration_ms").alias("mean_ms"), F.stddev_samp("duration_ms").alias("deviation_ms"), F.var_samp("duration_ms").alias("variance"),
        F.try_divide(F.stddev_samp("duration_ms"), F.avg("duration_ms")).alias("variation"), F.try_divide(F.max("duration_ms"), F.min("duration_ms")).alias("spread"),
        (F.count_if(F.col("ok")) / n).alias("success_rate"),
    )


def ranking(calls: DataFrame, by: str) -> DataFrame:
    """Groups by mean duration, with their place and speed class."""
    means = calls.groupBy(by).agg(F.avg("duration_ms").alias("mean_ms"), F.sum("total_tokens").alias("tokens"), F.sum("duration_ms").alias("ms"))
    rated = means.withColumn("tokens_per_second", F.try_divide(F.col("tokens") * 1000, F.col("ms")))
    level = F.when(F.col("mean_ms") > 3000, "HIGH").when(F.col("mean_ms") > 1500, "MEDIUM").otherwise("LOW")
    return rated.withColumn("place", F.row_number().over(Window.orderBy("mean_ms", by))).withColumn("latency", level)  # one row for each group


def extremes(calls: DataFrame, name: str) -> DataFrame:
    return calls.agg(F.min_by(name, F.struct("duration_ms", name)).alias("fastest"), F.max_by(name, F.struct("duration_ms", name)).alias("slowest"))


def scaling_exponent(runs: DataFrame) -> DataFrame:
    """ln(t2/t1) / ln(n2/n1) between the smallest and the largest ``n``; runs: (n, t)."""
    ends = runs.agg(F.min_by("t", "n").alias("t1"), F.max_by("t", "n").alias("t2"), F.min("n").alias("n1"), F.max("n").alias("n2"))
    return ends.select(F.try_divide(F.log(F.col("t2") / F.col("t1")), F.log(F.col("n2") / F.col("n1"))).alias("exponent"))

