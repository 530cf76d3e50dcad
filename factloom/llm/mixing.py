"""Mixing sources to target weights by Pivotal dependent rounding.

Every source gets a target in words; a document's copies are its source's
target over its source's size.  The whole part of that is taken as it is; the
fractional part is rounded by a pivotal scheme that keeps a source's words:
two documents with fractional probabilities move word mass between them, in a
randomly chosen direction, until one of them is integral, and the other one
goes on.  The expectation of every document stays what it was, and a source
ends with one fractional document, which is rounded to the nearer side.  So that
this one is small, documents of over 1/200 of their source (there are fewer than
200 of them) come first, from the largest down: each is paired with all smaller
ones of the source taken together, whose probabilities then move alike.

The pairs form a reduction tree.  A leaf holds about ``fanout`` documents of one
source and a random hash bucket, so a source with a third of all rows is spread
over as many leaves as its size asks for; each level keeps the one fractional
document of each node.  The leaf's fold runs in the JVM (``aggregate`` over a
bounded array).  All decisions follow from hashes of doc_id: reruns agree
whatever the partitions.

Rules for odd rows: null text has no words; documents without words take none;
a null source is a source of its own and the last in order; rows that share a
doc_id, or have none, are mixed as separate rows that share their random numbers
(of rows equal in doc_id, source and size, any may be the ones that are taken more
often); of a very long text only its size goes on; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import few, written

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SOURCES_SENT = 10_000  # beyond as many sources their targets are joined by a shuffle


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, total_share: float, cap: float, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) by water filling.

    Targets are proportional to weights, bounded by ``cap`` times a source's size,
    and what a bounded source leaves is shared among the others by weight.  Sources
    are ordered by cap*size/weight; for the k-th the level that would fill the rest
    is known from running sums, so no iteration is needed.  The table has one row
    for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("double")
    )
    everything = Window.partitionBy()
    level_order = Window.orderBy(F.col("fills"), F.col("i"))
    filled = (
        ranked.withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("fills", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(total_share))
        .withColumn("below", F.coalesce(F.sum("most").over(level_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(level_order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("left"))
        # the water stands at the first level that its source doesn't cut off: later ones are lower
        .withColumn("stands", F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(everything))
    )
    return filled.select(
        "source", "source_size",
        F.least(F.col("most"), F.coalesce(F.col("stands") * F.col("weight"), F.col("most"))).alias("target"),
    )


MEMBER = ("doc_id", "row", "size", "mass", "u")
LEAF = "struct<doc_id:bigint,row:bigint,size:double,mass:double,u:double>"
DONE = "array<struct<row:bigint,full:boolean>>"


def _leaf(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in MEMBER])


def _member(level: int, seed: int) -> Column:
    """A document among those of a node, the largest first."""
    return F.struct((-F.col("size")).alias("o"), "doc_id", "size", "mass", _unit(F.col("doc_id"), level, seed).alias("u"), "row")


def _unit(doc_id: Column, level: int, seed: int) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(doc_id, F.lit(level), F.lit(seed)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def _meet(acc: Column, x: Column) -> Column:
    """One pivotal step: acc and x exchange mass, one becomes integral and is noted in ``done``."""
    held, new = acc["held"], x
    up = F.least(held["size"] - held["mass"], new["mass"])  # from new to held
    down = F.least(held["mass"], new["size"] - new["mass"])  # from held to new
    move = F.when(new["u"] * (up + down) < down, up).otherwise(-down)
    a, b = held["mass"] + move, new["mass"] - move
    node = lambda of, mass: F.struct(*[(mass if c == "mass" else of[c]).alias(c) for c in MEMBER])
    # masses are exact at the bound that stopped the move
    new_done = F.when(move > 0, (up == new["mass"])).otherwise(down == new["size"] - new["mass"])
    new_full = move <= 0
    held_full = move > 0
    return F.when(
        held.isNull(), F.struct(node(new, new["mass"]).alias("held"), acc["done"].alias("done"))
    ).otherwise(
        F.struct(
            F.when(new_done, node(held, a)).otherwise(node(new, b)).alias("held"),
            F.concat(
                acc["done"],
                F.array(
                    F.struct(
                        F.when(new_done, new["row"]).otherwise(held["row"]).alias("row"),
                        F.when(new_done, new_full).otherwise(held_full).alias("full"),
                    )
                ),
            ).alias("done"),
        )
    )


def pivotal_round(units: DataFrame, fanout: int = 48, seed: int = 0) -> DataFrame:
    """(row, full) for ``units`` (source, doc_id, row, size, mass), 0 < mass < size.

    ``source`` may be null.  Each level writes its table, so a lost executor costs
    one level at most.  Levels needed: log(rows of a source) / log(fanout).
    """
    spark = units.sparkSession
    decided, level = None, 0
    while True:
        counts = units.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(fanout))).alias("nodes"))
        # one row for each source: as small as the result of the mix itself
        most = counts.agg(F.max("nodes")).first()[0]
        if most is None:
            return decided if decided is not None else spark.createDataFrame([], "row bigint, full boolean")
        keyed = units.join(
            F.broadcast(counts.withColumnRenamed("source", "s")) if few(counts, SOURCES_SENT) else counts.withColumnRenamed("source", "s"),
            F.col("source").eqNullSafe(F.col("s")),
        ).withColumn("node", F.pmod(F.xxhash64("doc_id", F.lit(level), F.lit(seed + 1)), F.col("nodes")))
        folded = keyed.groupBy("source", "node").agg(F.array_sort(F.collect_list(_member(level, seed))).alias("m")).select(
            "source",
            F.aggregate(
                F.transform("m", _leaf),
                F.struct(F.lit(None).cast(LEAF).alias("held"), F.array().cast(DONE).alias("done")),
                _meet,
            ).alias("r"),
        )
        folded = written(folded, f"mix-level{level}")
        done = folded.select(F.inline("r.done"))
        decided = done if decided is None else decided.unionByName(done)
        left = folded.select("source", "r.held.doc_id", "r.held.row", "r.held.size", "r.held.mass")
        whole = (F.col("mass") <= 0) | (F.col("mass") >= F.col("size"))
        decided = decided.unionByName(left.filter(whole).select("row", (F.col("mass") > 0).alias("full")))
        left = left.filter(~whole)
        if most == 1:
            return decided.unionByName(left.select("row", (F.col("mass") * 2 >= F.col("size")).alias("full")))
        units, level = left, level + 1


def _settle(rest: Column, x: Column) -> Column:
    """The largest document of ``rest`` against all others of it together; the document is decided."""
    mass = x["size"] * rest["mass"] / rest["size"]
    others, others_mass = rest["size"] - x["size"], rest["mass"] - mass
    up, down = F.least(x["size"] - mass, others_mass), F.least(mass, others - others_mass)
    rises = x["u"] * (up + down) < down
    after = F.when(rises, mass + up).otherwise(mass - down)
    # where the others became integral first, the document goes to the nearer side
    return F.struct(
        others.alias("size"),
        F.greatest(F.lit(0.0), F.least(others, F.when(rises, others_mass - up).otherwise(others_mass + down))).alias("mass"),
        F.concat(rest["done"], F.array(F.struct(x["row"].alias("row"), (after * 2 >= x["size"]).alias("full")))).alias("done"),
    )


def settle_large(units: DataFrame, sizes: DataFrame, share: float = 200.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Round the large documents against all smaller ones of their source.

    Gives (row, full) of the large ones, and the small ones with the masses
    that this leaves them.  A document is large if over 1/``share`` of its source, so a
    source's list has under ``share`` entries.
    """
    whole = sizes.select(F.col("source").alias("s"), "source_size")
    whole = F.broadcast(whole) if few(whole, SOURCES_SENT) else whole
    units = units.join(whole, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("large", F.col("size") * F.lit(share) > F.col("source_size"))
    entry = _member(-1, seed)
    by_source = units.groupBy("source").agg(
        F.sum("size").alias("all_size"), F.sum("mass").alias("all_mass"), F.array_sort(F.collect_list(F.when(F.col("large"), entry))).alias("m")
    )
    start = F.struct(F.col("all_size").alias("size"), F.col("all_mass").alias("mass"), F.array().cast(DONE).alias("done"))
    folded = written(by_source.select("source", F.aggregate(F.transform("m", _leaf), start, _settle).alias("r")), "mix-large")
    large = folded.select(F.inline("r.done"))
    rate = folded.select(F.col("source").alias("s"), F.when(F.col("r.size") > 0, F.col("r.mass") / F.col("r.size")).otherwise(0.0).alias("rate"))
    rate = F.broadcast(rate) if few(rate, SOURCES_SENT) else rate
    small = units.filter("not large").join(rate, F.col("source").eqNullSafe(F.col("s"))).select("source", "doc_id", "row", "size", (F.col("size") * F.col("rate")).alias("mass"))
    return large, small


def mix(docs: DataFrame, total_share: float = 1.5, cap: float = 2.0, fanout: int = 48, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of ``docs``."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sized = written(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")  # once written, a row keeps its number
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), total_share, cap), "mix-targets")
    wanted = targets.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("p"),
    )
    side = F.broadcast(wanted) if few(targets, SOURCES_SENT) else wanted
    planned = sized.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("base", F.floor("p")).withColumn(
        "mass", F.col("size") * (F.col("p") - F.col("base"))
    )
    units = planned.filter((F.col("mass") > 0) & (F.col("mass") < F.col("size"))).select(
        "source", "doc_id", "row", F.col("size").cast("double").alias("size"), "mass"
    )
    large, small = settle_large(units, targets, seed=seed)
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    rounded = pivotal_round(small.filter(open_), fanout, seed).unionByName(large).unionByName(
        small.filter(~open_).select("row", (F.col("mass") > 0).alias("full"))
    )
    extra = rounded.filter("full").select(F.col("row").alias("r"))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("r").isNotNull().cast("long")).otherwise(0).cast("long")
    return (
        planned.join(extra, F.col("row") == F.col("r"), "left")
        .select("doc_id", "source", F.col("size"), F.col("source_size"), F.col("target"), copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed(docs: DataFrame, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.  Rows without words are taken once."""
    plan = mix(docs.select("doc_id", "source", "text"), total_share, cap)
    plan = written(plan.select("doc_id", "source", "size", F.when(F.col("size") > 0, F.col("copies")).otherwise(1).alias("copies")), "mix-plan")
    names = {c: f"__factloom_{c}" for c in plan.columns}
    left, on = plan.withColumnsRenamed(names), F.col("doc_id").eqNullSafe(F.col("__factloom_doc_id"))
    rows = docs
    if not plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        # rows that share a doc_id are told apart by source and size, and numbered where these are equal too
        of_plan = Window.partitionBy(*[names[c] for c in ("doc_id", "source", "size")]).orderBy(F.desc(names["copies"]))
        left = left.withColumn("__factloom_n", F.row_number().over(of_plan))
        of_rows = Window.partitionBy("doc_id", "source", "__factloom_words").orderBy(F.xxhash64("text"))
        rows = docs.withColumn("__factloom_words", word_count(F.col("text"))).withColumn("__factloom_k", F.row_number().over(of_rows))
        on = on & F.col("source").eqNullSafe(F.col(names["source"])) & (F.col("__factloom_words") == F.col(names["size"])) & (F.col("__factloom_k") == F.col("__factloom_n"))
    # a plan has as many rows as the table, so it is dealt like it, whatever its size
    taken = rows.join(left.hint("merge"), on).filter("__factloom_copies > 0")
    return taken.withColumn("__factloom_copy", F.explode(F.sequence(F.lit(1), F.col("__factloom_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
