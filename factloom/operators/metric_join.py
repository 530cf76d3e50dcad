"""Pairs of similar vectors within groups, exactly, by pivots and the triangle inequality.

Cosine >= t is, for vectors of length 1, a distance of at most r = sqrt(2 - 2t).  A group
of n rows gets up to n / CELL_ROWS pivots, rows of it that lie far apart; a row is at home
with the pivot nearest to it.  If x and y are within r, x lies at most r beyond the plane
between their pivots: x visits the cells for which that holds and whose number is smaller
than its home's, so that each pair meets once, in the smaller of its two cells.  Within a
cell two rows are compared only if their distances from the pivot differ by at most r, as
the triangle inequality asks.

No task holds a group or a cell: rows meet pivots in parts of TASK_ROWS rows, and a
cell's comparisons are dealt out by pairs of slices of SLICE rows.  Vectors that don't
cluster aren't pruned: where rows of the sample would visit over VISITS cells, there are
fewer pivots, down to one, and all slices meet, evenly dealt.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_ROWS = 64
MAX_PIVOTS = 1_024  # of a group
TASK_ROWS = 20_000
SLICE = 2_000
VISITS = 8  # cells that a row of the sample visits on average, beside its home
SLACK = 1e-6  # of distances, for rounding


class VectorError(ValueError):
    """Vectors that can't be compared."""


UNEQUAL = "vectors of unequal lengths"


def own_columns(df: DataFrame) -> DataFrame:
    """``df`` with columns that its plan shares with nothing, as the other side of a cogroup must have."""
    return df.toDF(*df.columns)


def radius(threshold: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as rows of length 1; a vector of length zero becomes NaN, which compares false."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = set(np.diff(np.asarray(lists.offsets)).tolist())
    if len(sizes) > 1:
        raise VectorError(UNEQUAL)
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norms, out=np.full_like(v, np.nan), where=norms > 0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def _visits(u: np.ndarray, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each row goes to each pivot's cell, the row's own pivot, and the distances."""
    between = np.nan_to_num(_apart(p, p), nan=np.inf) + SLACK
    d = np.nan_to_num(_apart(u, p), nan=np.inf)
    mine = d.argmin(axis=1)
    near = d[np.arange(len(d)), mine]
    with np.errstate(invalid="ignore"):
        goes = (d**2 - near[:, None] ** 2 <= 2 * r * between[mine]) & (np.arange(d.shape[1])[None] <= mine[:, None]) & np.isfinite(near)[:, None]
    return goes, mine, d


def _pivots(rows: DataFrame, sizes: DataFrame, threshold: float, group: str) -> DataFrame:
    """(group, cell, pivot): of the rows with the smallest hashes, four for each pivot, those that lie far apart."""
    most = 4 * MAX_PIVOTS
    order = Window.partitionBy(group).orderBy(F.xxhash64("pos"), "pos")
    first = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)  # partial top rows in each task
    wanted = F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("n_rows") / CELL_ROWS)).cast("int")
    some = first.join(sizes, group).withColumn("wanted", wanted).filter(F.col("n") <= 4 * F.col("wanted")).select(group, "n", "wanted", "embedding")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    r = radius(threshold)

    def far_apart(held: pa.Table) -> pa.Table:
        held = held.sort_by("n")
        u = np.nan_to_num(unit(held.column("embedding")))
        chosen, least = [0], None
        for _ in range(min(held.column("wanted")[0].as_py(), len(u)) - 1):
            d = 1 - u @ u[chosen[-1]]
            least = d if least is None else np.minimum(least, d)
            if least.max() <= 1e-12:
                break
            chosen.append(int(least.argmax()))
        while len(chosen) > 1 and sum(int(_visits(u[i : i + 1000], u[chosen], r)[0].sum()) for i in range(0, len(u), 1000)) > (1 + VISITS) * len(u):
            chosen = chosen[: -(-len(chosen) // 4)]
        return pa.table({group: held.column(group).take(chosen), "cell": pa.array(range(len(chosen)), pa.int32()), "pivot": held.column("embedding").take(chosen)})

    return some.groupBy(group).applyInArrow(far_apart, f"{group} {kinds[group]}, cell int, pivot {kinds['embedding']}")


def cells(rows: DataFrame, threshold: float, group: str = "grp") -> DataFrame:
    """(group, cell, home, pos, embedding, d): each row in its home cell, and where it visits; rows without a direction meet nobody and are left out."""
    rows = rows.select(group, "pos", "embedding")
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    places = F.ceil(F.col("n_rows") / TASK_ROWS).cast("int")
    dealt = rows.join(sizes, group).withColumn("place", F.pmod(F.xxhash64("pos"), places).cast("int")).drop("n_rows")
    pivots = _pivots(rows, sizes, threshold, group).join(sizes, group).withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))).drop("n_rows")
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    r = radius(threshold)

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("cell")
        order = right.column("cell").to_numpy()
        u, p = unit(left.column("embedding")), unit(right.column("pivot"))
        if u.size and p.size and u.shape[1] != p.shape[1]:
            raise VectorError(UNEQUAL)
        at, cell, home, apart = [], [], [], []
        for i in range(0, len(u), 2000):
            goes, mine, d = _visits(u[i : i + 2000], p, r)
            x, c = np.nonzero(goes)
            at.append(x + i), cell.append(order[c]), home.append(c == mine[x]), apart.append(d[x, c])
        at = np.concatenate(at) if at else np.empty(0, int)
        taken = left.select([group, "pos", "embedding"]).take(pa.array(at))
        return pa.table({
            group: taken.column(group), "cell": pa.array(np.concatenate(cell).astype(np.int32) if cell else [], pa.int32()),
            "home": pa.array(np.concatenate(home) if home else [], pa.bool_()), "pos": taken.column("pos"), "embedding": taken.column("embedding"),
            "d": pa.array(np.concatenate(apart) if apart else [], pa.float64()),
        })

    out = f"{group} {fields[group]}, cell int, home boolean, pos {fields['pos']}, embedding {fields['embedding']}, d double"
    return dealt.groupBy(group, "place").cogroup(own_columns(pivots).groupBy(group, "place")).applyInArrow(assign, out)


def _sliced(met: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """A cell's home rows by slice, and all its rows by slice, each copied to the slices that it is compared with."""
    counts = met.groupBy(group, "cell").agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_visit"))
    slices = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / SLICE)).cast("int")
    known = met.join(counts.select(group, "cell", slices("n_home").alias("h"), F.when(F.col("n_visit") > 0, slices("n_visit")).otherwise(0).alias("v")), [group, "cell"])
    mine = F.pmod(F.xxhash64("pos", F.lit(1)), F.col("h")).cast("int")
    homes = known.filter("home").withColumn("i", mine)
    left = homes.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("h") + F.col("v") - 1)))
    right = homes.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j"))))
    visits = known.filter(~F.col("home")).withColumn("j", (F.col("h") + F.pmod(F.xxhash64("pos", F.lit(1)), F.col("v"))).cast("int"))
    visits = visits.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    columns = [group, "cell", "i", "j", "home", "pos", "embedding", "d"]
    return left.select(*columns), right.select(*columns).unionByName(visits.select(*columns))


def similar_pairs(rows: DataFrame, threshold: float, group: str = "grp") -> DataFrame:
    """(group, a, b, compared): a before b in order of ``pos``, of one group, with cosine >= threshold.

    ``rows``: pos (unique in its group), embedding and the group.  A pair with null a and b
    says how many comparisons a task made.  Vectors of unequal lengths are a VectorError.
    """
    left, right = _sliced(cells(rows, threshold, group), group)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    r = radius(threshold)

    def compare(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        made, a, b = 0, [np.empty(0, int)], [np.empty(0, int)]
        one, other = one.sort_by("d"), other.sort_by("d")
        pos = pa.concat_arrays([*one.column("pos").chunks, *other.column("pos").chunks, pa.array([], one.schema.field("pos").type)])
        if one.num_rows and other.num_rows:
            u, v, du, dv = unit(one.column("embedding")), unit(other.column("embedding")), one.column("d").to_numpy(), other.column("d").to_numpy()
            rank = pc.rank(pos, tiebreaker="dense").to_numpy()
            same = key[2].as_py() == key[3].as_py()  # a slice with itself holds each pair twice
            for i in range(0, len(u), 256):
                low, high = np.searchsorted(dv, [du[i] - r, du[min(i + 256, len(u)) - 1] + r])
                some = u[i : i + 256] @ v[low:high].T >= threshold
                made += some.size
                x, y = np.nonzero(some)
                x, y = x + i, y + low + len(u)
                before = rank[x] < rank[y]
                if same:
                    x, y, before = x[before], y[before], before[before]
                a.append(np.where(before, x, y).astype(np.int32)), b.append(np.where(before, y, x).astype(np.int32))
        a, b = (pos.take(pa.array(np.concatenate(c).astype(np.int32))) for c in (a, b))
        n, none = len(a), pa.nulls(1, pos.type)
        of = pa.concat_arrays([pa.array([key[0].as_py()], one.schema.field(group).type).take(pa.array(np.zeros(n + 1, np.int32)))])
        return pa.table({group: of, "a": pa.concat_arrays([a, none]), "b": pa.concat_arrays([b, none]), "compared": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([made], pa.int64())])})

    by = [group, "cell", "i", "j"]
    return left.groupBy(*by).cogroup(own_columns(right).groupBy(*by)).applyInArrow(compare, f"{group} {kinds[group]}, a {kinds['pos']}, b {kinds['pos']}, compared long")
