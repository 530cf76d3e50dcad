"""Centroids by sort-means over exact integer vectors.

Each component x of a vector becomes floor(scale * x).  The first centroids are the
vectors with the smallest SHA-256 of ``seed:id``.  A round orders, for each centroid, the
others by their distance from it; a vector scans them in the order of its previous
centroid and stops strictly beyond twice its distance from that one, since by the
triangle inequality no centroid further off is as near.  Distances are squared and
integer, ties go to the smaller number, and means are exact floors, so results don't
depend on how rows are dealt.

Tasks assign Arrow batches with numpy against k centroids; sums by centroid combine within
tasks, so that a centroid with most of the rows costs k rows a task.  Each round's
assignments are a written table, from which the next starts, and which it then deletes.

Vectors that are null, of another length, or hold a null or a number that isn't finite go;
rows that share an id, or have none, are vectors of their own (an absent id is the empty
text in the hash, and equal hashes go by components).  With fewer vectors than k all are
centroids; none give an empty result.  Other columns are left alone.  A component beyond
2**27 after scaling is an error, as squared distances would not fit 64 bits; sums that
don't are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, new_path
from .workers import bounded_batches, lean

LARGEST = 1 << 27
_SCHEMA = "id long, parts array<int>, cluster int, distance long"


def _components(vector: Column, dimension: int, scale: int) -> Column:
    """floor(scale * x) of each component, null where the vector is not kept."""
    x = lambda v: v.cast("double")
    good = (F.size(vector) == dimension) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < F.lit(float("inf"))))
    wide = F.exists(vector, lambda v: F.abs(F.floor(x(v) * scale)) > LARGEST)
    wide = F.when(wide, F.raise_error(F.lit(f"a component beyond {LARGEST}"))).cast("array<int>")
    return F.when(good, F.coalesce(wide, F.transform(vector, lambda v: F.floor(x(v) * scale).cast("int"))))


def kept_vectors(table: DataFrame, id_column: str, vector_column: str, dimension: int, scale: int) -> DataFrame:
    """(id, parts) of the vectors that take part."""
    return table.select(F.col(id_column).alias("id"), _components(F.col(vector_column), dimension, scale).alias("parts")).filter("parts is not null")


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of their id, in its order: a partial top-k in each task."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return np.array([r[0] for r in vectors.select("parts", by.alias("h")).orderBy("h", "parts").limit(k).select("parts").collect()], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def nearest(vectors: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector, scanning from its previous cluster."""
    between = squared(centroids[:, None], centroids[None])
    best, least = previous.copy(), np.empty(len(vectors), np.int64)
    for c in np.unique(previous):
        at = np.flatnonzero(previous == c)
        rows = vectors[at]
        current = squared(rows, centroids[c])
        near, distance = np.full(len(at), c), current.copy()
        order = np.argsort(between[c], kind="stable")
        open_ = np.arange(len(at))
        for other in order[order != c]:
            open_ = open_[between[c, other] <= 4 * current[open_]]  # distances are squares: twice becomes four times
            if not len(open_):
                break
            d = squared(rows[open_], centroids[other])
            better = (d < distance[open_]) | ((d == distance[open_]) & (other < near[open_]))
            near[open_[better]], distance[open_[better]] = other, d[better]
        best[at], least[at] = near, distance
    return best, least


ROWS = 8192  # of a batch that numpy works on at a time


def _assign(centroids: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("parts", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(tables):
        for t in tables:
            for at in range(0, t.num_rows, ROWS):
                some = t.slice(at, ROWS)
                parts = some.column("parts")
                vectors = parts.flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1).astype(np.int64)
                previous = some.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                best, least = nearest(vectors, previous, centroids)
                yield pa.RecordBatch.from_arrays([some.column("id"), parts, pa.array(best.astype(np.int32)), pa.array(least)], schema=schema)

    return run


def _sums(dimension: int):
    """A task's count and sums of each cluster that it met."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(tables):
        n, sums = {}, {}
        for t in tables:
            vectors = t.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            clusters = t.column("cluster").to_numpy(zero_copy_only=False)
            for c in np.unique(clusters).tolist():
                mine = vectors[clusters == c]
                n[c] = n.get(c, 0) + len(mine)
                sums[c] = sums.get(c, 0) + mine.sum(axis=0, dtype=np.int64)
        if n:
            yield pa.RecordBatch.from_pydict({"cluster": list(n), "n": list(n.values()), "sums": [s.tolist() for s in sums.values()]}, schema=schema)

    return run


def means(assigned: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of each cluster's mean; an empty one keeps its centroid.  k rows for each component come to the driver."""
    parts = assigned.select("parts", "cluster").mapInArrow(lean(_sums(centroids.shape[1])), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
    out = centroids.copy()
    for r in each.agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, dimension: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, parts, cluster, distance) of each vector after ``rounds`` of means and a last assignment, and the centroids."""
    spark = table.sparkSession
    bounded_batches(spark)
    vectors = kept_vectors(table, id_column, vector_column, dimension, scale)
    centroids = first_centroids(vectors, k, seed)
    state = vectors.select("id", "parts", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    if not len(centroids):
        return state, centroids
    before = None
    for n in range(rounds + 1):
        path = new_path(spark, f"means-{n}")
        state.mapInArrow(lean(_assign(centroids)), _SCHEMA).write.options(compression="zstd").parquet(path)
        state = spark.read.schema(_SCHEMA).parquet(path)
        if before:
            dropped(spark, before)
        before = path
        if n < rounds:
            centroids = means(state, centroids)
    return state, centroids


def as_long(total: Column) -> Column:
    return total.try_cast("long")


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) with the distances summed by cluster and over all, and the centroid's digest; a row a centroid is sent to all tasks."""
    spark = assigned.sparkSession
    hexed = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(hexed, "c int, centroid_sha256 string")
    sums = [(r["cluster"], r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()]
    total = sum((s for _, s in sums), start=0)
    by = spark.createDataFrame([(c, s) for c, s in sums], "of int, s decimal(38,0)").join(digests, F.col("of") == F.col("c"))
    found = assigned.join(F.broadcast(by), F.col("cluster") == F.col("of"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", as_long(F.col("s")).alias("cluster_inertia"), as_long(F.lit(total).cast("decimal(38,0)")).alias("inertia"), "centroid_sha256")
