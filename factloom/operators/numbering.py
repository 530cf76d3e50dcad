"""Places of rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import new_folder


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with the place (long, from 0) of each row in its group by ``order``.

    No group has to fit one task: rows are written in ranges of (group, order), counted by range and
    group, and a row's place is what its group holds in earlier ranges plus its place in its own.  The
    ranges are a written table because a second sampling of their bounds could cut elsewhere.

    Nulls are a group, and stand first in an order; rows with equal ``order`` stay in one range, in no
    promised order among themselves, so end it with what is unique.  ``parts`` is the number of ranges, else the
    session's.  A column named ``part`` or as ``name`` is an error.
    """
    if clash := {"part", name.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns of the result's own names: {sorted(clash)}")
    spark, path = df.sparkSession, new_folder(df.sparkSession, "numbered")
    keys = [*by, *order]
    ranged = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    ranged.withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int").parquet(path)
    own = rows.withColumn("_at", F.row_number().over(Window.partitionBy("part", *by).orderBy(*order)) - 1)
    before = Window.partitionBy(*[f"_{c}" for c in by]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    held = rows.groupBy(F.col("part").alias("_part"), *[F.col(c).alias(f"_{c}") for c in by]).agg(F.count(F.lit(1)).alias("_n"))
    base = held.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("part") == F.col("_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return own.join(base, same).select(*df.columns, (F.col("_base") + F.col("_at")).alias(name))

