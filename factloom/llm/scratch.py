"""Tables that cut lineage, in the folder that driver and executors share.

A written table survives the loss of executors and is read again as often as
needed.  The folder is the one in ``spark.checkpoint.dir``; only where that is
unset and Spark runs within one machine, as in tests, one of its own is made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI that Spark and pyarrow can write to."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:  # as Spark would resolve it, for pyarrow and executors too
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        base = path if "://" in path else path.replace(":", "://", 1)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """``df`` written once as Parquet, to a new path unless one is given, and read back with its own schema."""
    path = path or new_path(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(*columns) if columns else table


def few(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows: the check before a broadcast."""
    return df.limit(bound + 1).count() <= bound


STANDS_OUT = 10_000  # a key with over 1/STANDS_OUT of all rows is dealt over several places: there are fewer such keys than this
AT_A_PLACE = 256  # rows of a key that are never worth dealing


def stands_out(groups: DataFrame, key: str, count: str):
    """The keys that stand out by their rows, as (hot, places), and the place of a row from a hash of it.

    Their list has fewer than STANDS_OUT entries however large the table is, so it can
    be sent to all tasks: every other key is at most 1/STANDS_OUT of all rows.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    least = max(AT_A_PLACE, total // STANDS_OUT)
    places = F.ceil(F.col(count) / F.lit(least / 2)).cast("int")
    large = groups.filter(F.col(count) > least).select(F.col(key).alias("hot"), places.alias("places"))
    return large, lambda by: F.pmod(F.xxhash64(by), F.coalesce(F.col("places"), F.lit(1))).cast("int")


def dealt_join(rows: DataFrame, groups: DataFrame, key: str, group_key: str, count: str, by) -> DataFrame:
    """``rows`` left-joined to ``groups`` (unique ``group_key``, ``count`` rows of it, and more) on the key.

    Keys that stand out are dealt over several places by a hash of ``by``, with a copy of their group at each.
    """
    large, place = stands_out(groups, group_key, count)
    large = written(large, "hot-keys")
    if large.isEmpty():
        return rows.join(groups, F.col(key) == F.col(group_key), "left")
    large = F.broadcast(large.toDF("__hot", "places"))
    dealt = rows.join(large, F.col(key) == F.col("__hot"), "left").withColumn("__place", place(by)).drop("__hot", "places")
    copies = groups.join(large, F.col(group_key) == F.col("__hot"), "left")
    copies = copies.withColumn("__at", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("places"), F.lit(1)) - 1))).drop("__hot", "places")
    return dealt.join(copies, (F.col(key) == F.col(group_key)) & (F.col("__place") == F.col("__at")), "left").drop("__place", "__at")


IDS_SENT = 500_000  # identifiers of removed rows that a broadcast may hold, 8 bytes each


def without(docs: DataFrame, verdicts: DataFrame, part: str | None = None, of_row=None) -> DataFrame:
    """``docs`` without the doc_ids of which ``verdicts`` (doc_id, kept) keeps no row.

    Rows that share a doc_id, or have none, stay or go together, and of those that also
    share their text one stays; with ``part``, a column of the verdicts that ``of_row``
    gives for a row of ``docs``, they stay or go by their parts, and of a part that
    stays the row with the most code points does.
    """
    by_id = written(verdicts.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    repeated = not by_id.filter("n > 1").isEmpty()
    if repeated and part:
        keep = verdicts.filter("kept").select(F.col("doc_id").alias("__factloom_id"), F.col(part).alias("__factloom_part")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("__factloom_id")) & (F.col("__factloom_of") == F.col("__factloom_part"))
        left = docs.withColumn("__factloom_of", of_row).join(keep, same, "left_semi")
        order = Window.partitionBy("doc_id", "__factloom_of").orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))))
        first = left.withColumn("__factloom_n", F.row_number().over(order)).filter("__factloom_n = 1")
        return first.select(*[F.col(f"`{c}`") for c in docs.columns])
    removed = by_id.filter("not kept").select(F.col("doc_id").alias("__factloom_removed"))
    removed = F.broadcast(removed) if few(removed, IDS_SENT) else removed
    left = docs.join(removed, F.col("doc_id").eqNullSafe(F.col("__factloom_removed")), "left_anti")
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left
