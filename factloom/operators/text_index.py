"""A trigram posting index: substring searches read the rows that can match.

Beside the rows stand, for each batch, in Parquet:

* ``rows``: the rows as they come, partitioned by slot, which is that of runs of rows within a task; they aren't shuffled;
* ``entries`` (value, field, slot, n): the distinct lower-cased texts, and how often they stand in a slot's rows;
  in ranges of values, each a ``part``, so that texts that begin alike stand together;
* ``grams`` (gram, part, uses): the parts in which a text holds a gram of three code points;
* ``counts`` (gram, uses): how many rows' texts hold a gram.

A search takes the rarest grams of each term, meets the parts that have all of them, verifies
the texts themselves in these, and reads the slots in which such texts stand.  Slots only narrow:
the caller's predicate, applied to what ``candidates`` gives, decides.

A term of fewer than three code points has no gram, and one whose rarest gram stands in over
``SCAN_SHARE`` of all rows gains nothing: both read all rows, with the same answer.

Null texts have no entry, and match nothing.  Empty ones, and those of one or two signs, have
entries without grams: no longer term can stand in them.  Repeated rows come back as often as they were put in.  The names ``slot``,
``place`` and ``batch`` are the index's; columns of these names are an error.  An empty batch adds nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

FIELDS = ("subject", "predicate", "object")
GRAM = 3
PROBES = 4  # grams of a term that are looked up, rarest first
SCAN_SHARE = 0.1
SLOT_ROWS = 2_000
MAX_SLOTS = 4_096

PART_ROWS = 20_000  # rows to a part of their texts
MAX_PARTS = 1_024

_ENTRIES = "value string, field string, slot int, n long, part int"


def grams(term: str) -> list[str]:
    """The distinct grams of a term, in order of their first place."""
    return list(dict.fromkeys(term[i : i + GRAM] for i in range(len(term) - GRAM + 1)))


def build(rows: DataFrame, path: str, fields: tuple[str, ...] = FIELDS, slots: int | None = None) -> None:
    """Write the index of ``rows`` to a new folder; the numbers of slots, of parts and of a run's rows stay for later batches."""
    if clash := {"slot", "place", "batch"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns of the index's own names: {sorted(clash)}")
    total = rows.count()
    n = slots or min(MAX_SLOTS, max(1, total // SLOT_ROWS))
    about = {"schema": rows.schema.jsonValue(), "fields": list(fields), "slots": n, "run": math.ceil(total / n) or SLOT_ROWS, "parts": min(MAX_PARTS, max(1, total // PART_ROWS))}
    rows.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}/about")
    TextIndex(rows.sparkSession, path).append(rows)


class TextIndex:
    """An index that ``build`` has written, as of when it is opened."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads(spark.read.text(f"{self.path}/about").first()[0])
        self.schema, self.fields = StructType.fromJson(about["schema"]), about["fields"]
        self.slots, self.run, self.parts = about["slots"], about["run"], about["parts"]
        self.batches = self._done()
        uses = self._counts().filter(F.col("gram").isNull()).agg(F.sum("uses")).first()[0]
        self.total = uses or 0  # rows

    def _done(self) -> list[str]:
        """Batches whose counts are written to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        top = path(f"{self.path}/counts")
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return [n for n in sorted(names) if fs.exists(path(f"{self.path}/counts/{n}/_SUCCESS"))]

    def _read(self, part: str, schema) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*[f"{self.path}/{part}/{b}" for b in self.batches])
        return found.drop("batch")

    def _counts(self) -> DataFrame:
        return self._read("counts", "gram string, uses long")

    def append(self, rows: DataFrame) -> None:
        """Index one more batch; it is seen when its counts, which are written last, are there."""
        batch = f"batch={uuid.uuid4().hex}"
        row = F.monotonically_increasing_id()  # the task's number and, in 33 bits, the row's within it
        run = F.xxhash64(F.lit(batch), F.shiftright(row, 33), F.floor(row.bitwiseAND(F.lit(2**33 - 1)) / self.run))
        rows.select(*self.schema.names).withColumn("slot", F.pmod(run, F.lit(self.slots)).cast("int")).write.partitionBy("slot").parquet(f"{self.path}/rows/{batch}")
        stored = self.spark.read.schema(StructType([*self.schema.fields]).add("slot", IntegerType())).parquet(f"{self.path}/rows/{batch}")
        said = F.explode(F.array(*[F.struct(F.lower(c).alias("value"), F.lit(c).alias("field")) for c in self.fields])).alias("said")
        # rows that stand together repeat texts, which the aggregation combines within tasks
        entries = stored.select("slot", said).filter("said.value is not null").groupBy("said.value", "said.field", "slot").agg(F.count(F.lit(1)).alias("n"))
        entries.repartitionByRange(self.parts, "value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(
            f"{self.path}/entries/{batch}"
        )
        long = self.spark.read.schema(_ENTRIES).parquet(f"{self.path}/entries/{batch}").filter(F.length("value") >= GRAM)
        cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("value") - GRAM + 1), lambda i: F.substring("value", i, F.lit(GRAM))))
        posted = long.select(F.explode(cut).alias("gram"), "part", "n").groupBy("gram", "part").agg(F.sum("n").alias("uses"))
        posted.repartitionByRange("gram").sortWithinPartitions("gram", "part").write.parquet(f"{self.path}/grams/{batch}")
        counted = self.spark.read.schema("gram string, uses long").parquet(f"{self.path}/grams/{batch}").groupBy("gram").agg(F.sum("uses").alias("uses"))
        total = stored.agg(F.lit(None).cast("string").alias("gram"), F.count(F.lit(1)).alias("uses"))
        counted.unionByName(total).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/counts/{batch}")
        self.__init__(self.spark, self.path)

    def rows(self, slots: list[int] | None = None) -> DataFrame:
        """All rows, or those of some slots."""
        found = self._read("rows", StructType([*self.schema.fields]).add("slot", IntegerType()))
        return (found if slots is None else found.filter(F.col("slot").isin(slots))).drop("slot")

    def probes(self, terms: list[str]) -> dict[str, list[str]] | None:
        """The grams to look up for each lower-cased term that can occur; None where all rows are to be read.

        What comes to the driver is a row for each gram of the query.
        """
        asked = {t: grams(t) for t in (t.lower() for t in terms)}
        if any(not g for g in asked.values()):
            return None
        wanted = sorted({g for gs in asked.values() for g in gs})
        known = {r["gram"]: r["uses"] for r in self._counts().filter(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("uses").alias("uses")).collect()} if wanted else {}
        out, expected = {}, 0
        for t, gs in asked.items():
            if all(g in known for g in gs):
                out[t] = sorted(gs, key=lambda g: (known[g], g))[:PROBES]
                expected += known[out[t][0]]
        return None if expected > SCAN_SHARE * self.total else out

    def places(self, probes: dict[str, list[str]], fields: list[str] | None = None) -> DataFrame:
        """The distinct places, which are slots, of texts that hold a term."""
        posted = self._read("grams", "gram string, part int")
        found = []
        for term, gs in probes.items():
            held = posted.filter(F.col("gram").isin(gs)).groupBy("part").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(gs))
            parts = [r["part"] for r in held.collect()]  # MAX_PARTS numbers at most
            entries = self._read("entries", _ENTRIES).filter(F.col("part").isin(parts) & F.col("field").isin(fields or self.fields))
            found.append(entries.filter(F.contains("value", F.lit(term))).select(F.col("slot").alias("place")))
        return reduce(DataFrame.unionByName, found).distinct() if found else self.spark.createDataFrame([], "place int")

    def candidates(self, terms: list[str], fields: list[str] | None = None) -> DataFrame:
        """Rows among which are all that hold a term in one of ``fields``; all rows where the index wouldn't help."""
        probes = self.probes(terms)
        return self.rows(None if probes is None else [r["place"] for r in self.places(probes, fields).collect()])  # MAX_SLOTS numbers at most
