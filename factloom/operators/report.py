"""Reports over a run: groups, comparisons of tests, cleaning up, and the files they are written to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .filters import vectors_of
from .store import without_ids


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """(name, n) by the first of the columns that has a value, ``unknown`` where none has."""
    named = [F.when(F.col(c) != "", F.col(c)) for c in columns]
    return df.groupBy(F.coalesce(*named, F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def tests_summary(results: DataFrame) -> DataFrame:
    """One row over tests (success, duration): how many, how they went, and how long they took."""
    n = F.count(F.lit(1))
    return results.agg(
        n.alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("duration"), F.lit(0)).alias("total_duration"), F.avg("duration").alias("mean_duration"),
    )


def grouped_extremes(runs: DataFrame, name: str, value: str) -> DataFrame:
    """Over groups of ``name``: the mean of ``value`` by group, averaged, and the groups with the least and the greatest."""
    means = runs.groupBy(name).agg(F.avg(value).alias("mean"))
    order = F.struct("mean", name)
    return means.agg(F.avg("mean").alias("mean_of_means"), F.min_by(name, order).alias("lowest"), F.max_by(name, order).alias("highest"))


def by_efficiency(groups: DataFrame) -> DataFrame:
    """Groups (efficiency, speed) by whole efficiency, then by speed, with their place.

    Efficiencies that differ by less than 1 count as equal; as that is no order, whole
    numbers stand for it.  One row for each group of a report.
    """
    order = Window.orderBy(F.desc(F.round("efficiency")), F.desc("speed"))
    return groups.withColumn("place", F.row_number().over(order))


def bottlenecks(tests: DataFrame) -> DataFrame:
    """(name, latency, reliability, speed) classes of tests (name, mean_ms, success_rate, tokens_per_second)."""
    latency = F.when(F.col("mean_ms") > 3000, "HIGH").when(F.col("mean_ms") > 1500, "MEDIUM").otherwise("LOW")
    return tests.select(
        "name", latency.alias("latency"), F.when(F.col("success_rate") < 0.9, "LOW").otherwise("HIGH").alias("reliability"),
        F.when(F.col("tokens_per_second") < 20, "SLOW").otherwise("FAST").alias("speed"),
    )


def sample(df: DataFrame, n: int = 5, order: str = "id") -> DataFrame:
    return df.orderBy(order).limit(n)


def cleaned(tables: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without a run's rows, in the order of what depends on what.

    ``gone``: ids of triples, concepts, token_usage and jobs.  Vectors go with their
    triples and concepts, links with their concepts.
    """
    out = dict(tables)
    none = next(iter(tables.values())).sparkSession.createDataFrame([], "id string")
    triples, concepts = gone.get("triples", none), gone.get("concepts", none)
    out["vectors"] = without_ids(out["vectors"], vectors_of(out["vectors"], triples, concepts).select(F.col("vector_id").alias("id")), "vector_id")
    named = out["concepts"].join(concepts.select("id").distinct(), "id", "left_semi").select("concept", "source", "source_type").distinct()
    links = out["conceptualizations"]
    same = [links[c].eqNullSafe(named[c]) for c in ("concept", "source", "source_type")]
    out["conceptualizations"] = links.join(named, same, "left_anti")
    for name in ("concepts", "triples", "token_usage", "jobs"):
        if name in gone and name in out:
            out[name] = without_ids(out[name], gone[name])
    return out


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns))).collect()]


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in any store that Spark writes to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def report(triples: DataFrame, concepts: DataFrame, vectors: DataFrame, usage: DataFrame, log: str = "") -> dict:
    """What a run did: counts by group, sums, and samples of a few rows; all that comes to the driver is of a fixed size."""
    sums = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens", "estimated_cost")], F.count(F.lit(1)).alias("calls"))
    return {
        "triples_by_type": {r["name"]: r["n"] for r in counts_by(triples, "type").collect()},
        "concepts_by_level": {r["name"]: r["n"] for r in counts_by(concepts, "abstraction_level").collect()},
        "vectors_by_type": {r["name"]: r["n"] for r in counts_by(vectors, "vector_type").collect()},
        "usage": _rows(sums)[0], "sample_triples": _rows(sample(triples)), "sample_concepts": _rows(sample(concepts)), "log": log[-5000:],
    }


def as_markdown(r: dict) -> str:
    lines = ["# Pipeline report"]
    for title, key in (("Triples by type", "triples_by_type"), ("Concepts by level", "concepts_by_level"), ("Vectors by type", "vectors_by_type"), ("Token usage", "usage")):
        lines += ["", f"## {title}", *[f"- {k}: {v}" for k, v in sorted(r[key].items())]]
    for title, key in (("Sample triples", "sample_triples"), ("Sample concepts", "sample_concepts")):
        lines += ["", f"## {title}", "```json", json.dumps(r[key], indent=2, ensure_ascii=False), "```"]
    return "\n".join([*lines, "", "## Log", "```", r["log"], "```", ""])


def write_report(spark: SparkSession, path: str, r: dict) -> None:
    """``path``.md and ``path``.json."""
    write_file(spark, f"{path}.md", as_markdown(r))
    write_file(spark, f"{path}.json", json.dumps(r, ensure_ascii=False))
