"""Sessions for tests, benches and notebooks; on a cluster, settings come from its own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("factloom")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
