"""Exact dedup by a log-structured merge index.

Memtables: every task digests its rows and flushes them sorted by digest; the
tasks' files of one memtable number are a run of level 0, Parquet with a Bloom
filter on the digest.  Compaction merges ``fan_in`` runs of a level into one of the
next until one run is left: for each digest the count and the best row (most code
points, then the smallest identifier, null last, then the first row), combined
within each task before the shuffle, so a digest with a third of all rows costs
one row for each task.

Hits are the digests of more than one row in the last run.  A filter of their own,
a bitmap of bounded size, sends every row to one of two ways: rows that it excludes
stand alone and are never shuffled; the others meet the hits by an exact join.
Hits get byte verification: the texts behind a digest are compared with the text
of the row that stays.  Should two texts ever share a digest, their rows are
grouped by the bytes themselves.

Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null counts as
empty, and empty texts are equal to each other.  Rows that repeat a doc_id are
rows of their own: of equal ones a single row stays.  The time of a very long text
follows its length; only its digest is shuffled, unless it has copies.  An empty
table gives an empty result; other columns are carried only by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import dealt_join, dropped, new_path, stands_out, without, written

BLANKS = " \t\n\x0b\x0c\r"
FILTER_BITS = 1 << 22  # of the hits' filter at most; beyond some 260,000 hits it lets more rows through to the exact join


def normal_text(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:  # faster than one pass of translate, which looks up every character
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


class LogStructuredIndex:
    """Digest -> (rows, best row).  ``add`` flushes runs, ``compact`` merges a level, ``probe`` looks up."""

    #: of the best row: (-code points, doc_id, number of the row within its flush)
    RUN = "digest binary, doc_id bigint, neg_points int, row bigint, n_rows bigint"

    def __init__(self, spark: SparkSession, fan_in: int = 8, memtables: int = 64):
        self.spark, self.fan_in, self.memtables = spark, fan_in, memtables
        self.levels: dict[int, list[tuple[str, int]]] = {}  # of each level its folders, and how many runs each holds

    def _flush(self, rows: DataFrame, level: int, runs: int) -> None:
        path = new_path(self.spark, f"lsm-level{level}")
        rows.sortWithinPartitions("run", "digest").write.partitionBy("run").options(
            **{"compression": "zstd", "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "20000"}
        ).parquet(path)
        self.levels.setdefault(level, []).append((path, runs))

    def add(self, rows: DataFrame) -> None:
        """Flush ``rows`` (digest, doc_id, neg_points): each task's go to one of the memtables, sorted."""
        numbered = rows.select("digest", "doc_id", "neg_points", F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("n_rows"))
        self._flush(numbered.withColumn("run", F.spark_partition_id() % self.memtables), 0, self.memtables)

    def runs(self, level: int) -> DataFrame:
        """The entries of a level, and the folder and number of their run."""
        out = None
        for k, (path, _) in enumerate(self.levels.get(level, [])):
            one = self.spark.read.schema(f"{self.RUN}, run int").parquet(path).withColumn("folder", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], f"{self.RUN}, run int, folder int") if out is None else out

    @staticmethod
    def merged(runs: DataFrame, *by: str) -> DataFrame:
        best = F.min(F.struct("neg_points", F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
        out = runs.groupBy(*by, "digest").agg(best, F.sum("n_rows").alias("n_rows"))
        return out.select(*by, "digest", "best.doc_id", "best.neg_points", "best.row", "n_rows")

    def compact(self, level: int) -> None:
        """Merge each ``fan_in`` runs of a level into one run of the next level."""
        first, total, number = 0, 0, F.lit(0)
        for k, (_, runs) in enumerate(self.levels[level]):
            number = F.when(F.col("folder") == k, F.col("run") + first).otherwise(number)
            first, total = first + runs, total + runs
        merged = self.merged(self.runs(level).withColumn("run", F.floor(number / self.fan_in).cast("int")), "run")
        folders = self.levels.pop(level)
        self._flush(merged, level + 1, -(-total // self.fan_in))
        for path, _ in folders if level else ():  # level 0 has the rows themselves
            dropped(self.spark, path)

    def compact_all(self) -> int:
        """Compact level by level until one run is left; gives its level.  Level 0 is kept as it was flushed."""
        flushed, level = list(self.levels[0]), 0
        while level < max(self.levels) or sum(n for _, n in self.levels[level]) > 1:
            self.compact(level)
            level += 1
        self.levels[0] = flushed
        return level

    def probe(self, digests: list[bytes]) -> DataFrame:
        """Entries of a few digests, whatever levels they are in; the runs' Bloom filters keep most files unread."""
        named = F.col("digest").isin([bytearray(d) for d in digests])
        found = None
        for level in self.levels:
            one = self.runs(level).filter(named)
            found = one if found is None else found.unionByName(one)
        return self.merged(found)


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normal_text(text), 256))


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        digest_of(F.col("text")).alias("digest"),
        (-F.length(F.coalesce("text", F.lit("")))).cast("int").alias("neg_points"),
    )


def _bit(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def hit_filter(hits: DataFrame, n_hits: int) -> tuple[DataFrame, int]:
    """One row with a bitmap of at most FILTER_BITS bits, as ``words``, and the number of its bits."""
    bits = 64
    while bits < min(FILTER_BITS, 16 * n_hits):
        bits *= 2
    at = _bit(F.col("digest"), bits)
    some = hits.select(F.floor(at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    some = some.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = hits.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").cast("int").alias("word")).join(some, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return every.agg(F.transform(ordered, lambda x: x["bits"]).alias("words")), bits


def maybe_hit(words: Column, digest: Column, bits: int) -> Column:
    """False for every digest that is no hit, but for some that share a bit with one."""
    at = _bit(digest, bits)
    return F.call_function("shiftrightunsigned", F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _clashing(docs: DataFrame, hits: DataFrame, filtered) -> DataFrame:
    """Digests whose rows differ in bytes from the row that stays.

    The keeper's text goes to as many places as its group stands out by, so the work
    of one task doesn't follow the size of a group.
    """
    rows = docs.select("doc_id", digest_of(F.col("text")).alias("digest"), normal_text(F.col("text")).alias("bytes"))
    rows = filtered(rows)  # rows that nothing equals are not dealt
    large, places = stands_out(hits, "digest", "n_rows")
    keys = hits.select(F.col("digest").alias("of"), F.col("doc_id").alias("keep_id"))
    keepers = rows.join(keys, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", F.col("bytes").alias("kept_bytes")).dropDuplicates(["digest"])
    keepers = keepers.join(F.broadcast(large), F.col("digest") == F.col("hot"), "left")
    keepers = keepers.select(F.col("digest").alias("of"), "kept_bytes", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("places"), F.lit(1)) - 1)).alias("at"))
    others = rows.join(F.broadcast(large), F.col("digest") == F.col("hot"), "left").select("digest", "bytes", places(F.col("doc_id")).alias("place"))
    both = others.join(keepers, (F.col("digest") == F.col("of")) & (F.col("place") == F.col("at")))
    return both.filter(F.col("bytes") != F.col("kept_bytes")).select("digest").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``."""
    spark = docs.sparkSession
    index = LogStructuredIndex(spark)
    index.add(_digested(docs))
    last = index.compact_all()
    hits = written(index.runs(last).filter("n_rows > 1").drop("run", "folder"), "lsm-hits")
    found, bits = hit_filter(hits, hits.count())
    found = written(found, "lsm-filter")

    def filtered(rows: DataFrame, hit: bool = True) -> DataFrame:
        maybe = maybe_hit(found.scalar(), F.col("digest"), bits)
        return rows.filter(maybe if hit else ~maybe)

    if not written(_clashing(docs, hits, filtered), "lsm-clashes").isEmpty():
        return _by_bytes(docs)
    rows = index.runs(0).select("digest", "doc_id", "neg_points", "row")
    alone = filtered(rows, False).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    best = hits.select(F.col("digest").alias("of"), F.col("doc_id").alias("best_id"), F.col("row").alias("best_row"), "n_rows")
    met = dealt_join(filtered(rows), best, "digest", "of", "n_rows", F.col("row"))
    is_hit = F.col("of").isNotNull()
    met = met.select(
        "doc_id",
        F.when(is_hit, F.col("best_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n_rows", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("best_row"), F.lit(True)).alias("kept"),
        "digest",
    )
    return alone.unionByName(met).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _by_bytes(docs: DataFrame) -> DataFrame:
    """The groups by the texts themselves, for tables in which two texts share a digest."""
    rows = docs.select("doc_id", normal_text(F.col("text")).alias("bytes"), (-F.length(F.coalesce("text", F.lit("")))).alias("neg_points"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "lsm-texts")
    best = F.min(F.struct("neg_points", F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("best")
    groups = rows.groupBy("bytes").agg(best, F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "bytes").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.sha2("bytes", 256).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return without(docs, exact_groups(docs).select("doc_id", "kept", "text_sha256"), "text_sha256", F.sha2(normal_text(F.col("text")), 256))
