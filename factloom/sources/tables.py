"""Reading tables and files with declared schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CODEC

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(text, source): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("source"))


#: What each request may hold, and what is required and bounded in it.
REQUESTS = {
    "process": ("text string, source string, source_type string, source_date timestamp", ("text", "source", "source_type", "source_date"), {}),
    "search": ("query string, limit int, threshold double, entity double, relationship double, semantic double, concept double", ("query",),
               {"limit": (1, 100), "threshold": (0, 1), "entity": (0, 1), "relationship": (0, 1), "semantic": (0, 1), "concept": (0, 1)}),
    "concepts": ("query string, abstraction string, limit int", ("query",), {"limit": (1, 100)}),
}


def requests(lines: DataFrame, kind: str = "process", column: str = "value") -> DataFrame:
    """JSON requests of a kind with a verdict instead of an exception.

    Required fields are there and not blank, numbers are within their bounds, an
    abstraction is high, medium or low.
    """
    schema, required, bounds = REQUESTS[kind]
    r = lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("r"), F.col(column).alias("raw")).select("r.*", "raw")
    ok = F.lit(True)
    for c in required:
        ok = ok & (F.length(F.trim(F.col(c).cast("string"))) > 0)
    for c, (low, high) in bounds.items():
        ok = ok & (F.col(c).isNull() | F.col(c).between(low, high))
    if kind == "concepts":
        ok = ok & (F.col("abstraction").isNull() | F.lower("abstraction").isin("high", "medium", "low"))
    return r.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("error", F.when(~F.col("ok"), "INPUT_VALIDATION_ERROR"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder of ``spark.checkpoint.dir``, which driver and executors share; unset, a local session gets one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:  # as Spark would resolve it
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a new folder and read from there, so that what follows doesn't work it out again."""
    df.write.parquet(path, compression=CODEC)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BUILT: dict[tuple[str, str], object] = {}


def once(spark: SparkSession, key: str, build: Callable[[str], object]) -> object:
    """What ``build`` makes in a new folder, made once in a session."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _BUILT:
        _BUILT[at] = build(new_folder(spark, "published"))
    return _BUILT[at]


def published(spark: SparkSession, derive: Callable[[], DataFrame], key: str) -> DataFrame:
    """A table derived and written once in a session, and read from there after."""

    def build(path: str) -> tuple[str, object]:
        df = derive()
        df.write.parquet(path, compression=CODEC)
        return path, df.schema

    path, schema = once(spark, key, build)
    return spark.read.schema(schema).parquet(path)
