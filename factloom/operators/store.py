"""Writing: insert-ignore, upsert, vector rows, staged publishing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clamp_confidence, safe_id, sanitize, semantic_text
from ..schema import CODEC, TRIPLE_KEY


def new_rows(batch: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not stored yet, one for each key."""
    return batch.dropDuplicates(key).join(stored.select(*key), key, "left_anti")


def existing_ids(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.select("id").join(ids.select("id").distinct(), "id", "left_semi")


def upsert(stored: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key; the batch wins against what is stored."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("_new"), F.desc(version))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", "_new")


def without_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")


def cleaned_triples(raw: DataFrame) -> DataFrame:
    parts = {c: sanitize(F.col(c), 5000) for c in ("subject", "predicate", "object")}
    return raw.withColumns(parts | {"confidence": clamp_confidence(F.col("confidence")).cast("decimal(3,2)")}).withColumn("id", safe_id(*TRIPLE_KEY))


def vector_texts(triples: DataFrame) -> DataFrame:
    """(id, vector_type, text): subject and object, once if they are equal, predicate, and the whole."""
    kinds = F.array(
        F.struct(F.lit("ENTITY").alias("vector_type"), F.col("subject").alias("text")),
        F.struct(F.lit("ENTITY").alias("vector_type"), F.col("object").alias("text")),
        F.struct(F.lit("RELATIONSHIP").alias("vector_type"), F.col("predicate").alias("text")),
        F.struct(F.lit("SEMANTIC").alias("vector_type"), semantic_text().alias("text")),
    )
    return triples.select("id", F.explode(F.array_distinct(kinds)).alias("v")).select("id", "v.*")


SENT_TEXTS = 10_000  # of predicates with their embeddings that are sent to the triples; more are met by a shuffle


def known_texts(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, vector_type, text, embedding) of what the dictionary (text, embedding) has.

    A predicate can be that of most triples, which a shuffle by text would bring to one task:
    as long as there are few with an embedding, they go to the triples.
    """
    texts = vector_texts(triples)
    said = dictionary.join(triples.select(F.col("predicate").alias("text")).distinct(), "text", "left_semi")
    if said.limit(SENT_TEXTS + 1).count() > SENT_TEXTS:
        return texts.join(dictionary, "text").select("id", "vector_type", "text", "embedding")
    predicates = triples.select("id", F.lit("RELATIONSHIP").alias("vector_type"), F.col("predicate").alias("text")).join(F.broadcast(said), "text")
    rest = texts.filter("vector_type <> 'RELATIONSHIP'").join(dictionary, "text")
    return predicates.unionByName(rest).select("id", "vector_type", "text", "embedding")


def vector_rows(found: DataFrame) -> DataFrame:
    return found.select(
        safe_id(F.col("id"), F.col("vector_type"), F.col("text")).alias("vector_id"), "text", "embedding", "vector_type",
        F.when(F.col("vector_type") == "ENTITY", F.col("text")).alias("entity_name"), F.col("id").alias("knowledge_triple_id"),
        F.lit(None).cast("string").alias("concept_node_id"),
    )


def materialise_vectors(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Vector rows of triples whose texts the dictionary (text, embedding) has."""
    return vector_rows(known_texts(triples, dictionary))


def missing_texts(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Texts without a vector, by kind.

    Names and predicates repeat, which tasks combine before they send them.  Whole triples
    hardly do, and a task would keep all of its own for nothing: they are dealt first.
    """
    kind = lambda name, text: triples.select(F.lit(name).alias("vector_type"), text.alias("text"))
    entities = triples.select(F.lit("ENTITY").alias("vector_type"), F.explode(F.array("subject", "object")).alias("text"))
    texts = entities.distinct().unionByName(kind("RELATIONSHIP", F.col("predicate")).distinct()).unionByName(kind("SEMANTIC", semantic_text()).repartition("text").distinct())
    return texts.join(dictionary.select("text"), "text", "left_anti")


def wrong_dimension(vectors: DataFrame, n: int = 1536) -> DataFrame:
    return vectors.filter(F.size("embedding") != n)


def checked_vectors(vectors: DataFrame, n: int) -> DataFrame:
    """``vectors``, all of dimension ``n``; one that isn't rejects them all before anything is written."""
    wrong = wrong_dimension(vectors, n).select("vector_id").limit(1).collect()
    if wrong:
        raise ValueError(f"VECTOR_DIMENSION_ERROR: {wrong[0][0]} has not {n} numbers")
    return vectors


def concept_vectors(concepts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Vector rows of concepts whose names the dictionary (text, embedding) has."""
    found = concepts.select(F.col("id").alias("concept_node_id"), F.col("concept").alias("text")).join(dictionary, "text")
    return found.select(
        safe_id(F.col("concept_node_id"), F.lit("CONCEPT"), F.col("text")).alias("vector_id"), "text", "embedding", F.lit("CONCEPT").alias("vector_type"),
        F.lit(None).cast("string").alias("entity_name"), F.lit(None).cast("string").alias("knowledge_triple_id"), "concept_node_id",
    )


def concept_id() -> Column:
    return safe_id(F.col("concept"), F.col("abstraction_level"), F.col("source"))


def conceptualization_id() -> Column:
    return safe_id(F.col("source_element"), F.col("source_type"), F.col("concept"))


def cleaned_concepts(raw: DataFrame) -> DataFrame:
    """Names of at most 2000 characters without control characters; levels in upper case; confidence from 0 to 1."""
    said = {"concept": sanitize(F.col("concept"), 2000), "abstraction_level": F.upper("abstraction_level"), "confidence": clamp_confidence(F.col("confidence")).cast("decimal(3,2)")}
    return raw.withColumns(said).withColumn("id", concept_id())


NO_DECIMAL = "[A-DF-Za-df-z]"  # decimals have signs, digits, points, and an E or e before an exponent


def strict_casts(raw: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns as other types; what can't be read becomes null instead of an error.

    Trying a decimal costs an exception for each text that is none, so those with a letter
    that no decimal has aren't tried.
    """
    said = {f.name: f.dataType.simpleString() for f in raw.schema}

    def cast(c: str, k: str) -> Column:
        tried = F.col(c).try_cast(k)
        return F.when(~F.col(c).rlike(NO_DECIMAL), tried) if said.get(c) == "string" and k.lower().startswith("decimal") else tried

    return raw.withColumns({c: cast(c, k) for c, k in kinds.items()})


class Store:
    """Tables published together: a batch becomes visible when the manifest names its folders.

    A table is a list of data folders, each with the numbers of the manifests that first
    named its rows, and a list of delete folders: keys, each with the number up to which
    rows that have it are gone.  Reading joins the two, so that deleting or replacing rows
    writes as much as the batch holds and never the table.  A failed batch leaves folders
    that nothing names.

    Manifests are numbered files; a publication writes the one after the manifest that
    it read, through Hadoop's file system, so that of two at a time one finds the number
    taken and starts from the other's.  What it appends stays as written, but for rows
    whose unique key the other has published meanwhile; what it deletes is what it had
    read; what it replaces is worked out again from what is stored then.

    A delete of over REWRITTEN keys that takes most of a table writes what is left of the
    table instead: that is less than the keys, which every reading would join with all rows.

    A table of over FOLDERS data folders has its smallest ones merged into one, without
    the rows that are deleted: large folders are rarely written again.  Merged rows keep
    their numbers, for deletes of publishers that worked from an earlier manifest.  Over DELETES
    delete folders become one, and go where no data folder is as old as they are.

    ``keys``: unique keys by table.  Beside each data folder of such a table stands its
    membership filter, the 64-bit hashes of its keys, so that ``new_rows`` reads the
    folders in which a key of the batch can be and no others.

    ``views``: by table and name, a function that counts rows: columns to group by, and
    ``n``.  Each publication writes its own counts, those of rows that it deletes with a
    minus; ``view`` adds them up and never reads the table's rows.  Whatever follows from
    the rows as a multiset, the greatest value of a column too, follows from such counts.
    """

    FOLDERS = 64  # of a table's data, from which on a publication merges the smallest
    DELETES = 16
    REWRITTEN = 100_000  # keys of a delete, from which on it may write the rest of the table

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]] | None = None, views: dict[str, dict[str, Callable[[DataFrame], DataFrame]]] | None = None):
        self.spark, self.root, self.keys, self.views = spark, root.rstrip("/"), keys or {}, views or {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> tuple[int, dict[str, dict[str, list]]]:
        """The last manifest's number, 0 if there is none, and what it names: by table, data and deletes."""
        versions = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        if not versions:
            return 0, {}
        last = max(str(v.getPath()) for v in versions)
        return int(last[-17:-5]), json.loads("".join(r[0] for r in self.spark.read.text(last, wholetext=True).collect()))

    def read(self, table: str, schema: str, as_of: dict | None = None) -> DataFrame:
        """The table's rows, of the last manifest or of one that was read before."""
        named = (self.manifest()[1] if as_of is None else as_of).get(table, {})
        return self._rows(named.get("data", []), named.get("deletes", []), schema)

    def holds(self, table: str, upto: int) -> bool:
        """Whether the table has a data folder with rows of the manifest of this number or an earlier one."""
        return any(low <= upto for _, low, _ in self.manifest()[1].get(table, {}).get("data", []))

    def _hashes(self, name: str, rows: DataFrame, schema: str) -> DataFrame:
        """(h) of the rows' keys, in the types of the table."""
        kinds = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
        return rows.select(F.xxhash64(*[F.col(c).cast(kinds[c]) for c in self.keys[name]]).alias("h"))

    def _filter(self, name: str, folder: str, schemas: dict[str, str]) -> dict[str, str]:
        """The folder's membership filter, by the folder; none for a table without a known key."""
        if name not in self.keys or name not in schemas:
            return {}
        rows = self.spark.read.schema(schemas[name]).parquet(folder)
        return {folder: self._written(f"{name}-filters", self._hashes(name, rows, schemas[name]).sortWithinPartitions("h"))}

    def may_hold(self, name: str, batch: DataFrame, schema: str, as_of: dict | None = None) -> list[str]:
        """The table's data folders in which a key of the batch can be: at most FOLDERS names."""
        named = (self.manifest()[1] if as_of is None else as_of).get(name, {})
        filters = named.get("filters", {})
        sure = [d[0] for d in named.get("data", []) if d[0] not in filters]
        if not filters:
            return sure
        of = {f.rsplit("/", 1)[-1]: folder for folder, f in filters.items()}
        held = self.spark.read.schema("h bigint").parquet(*filters.values()).withColumn("f", F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1))
        hit = held.join(self._hashes(name, batch, schema), "h", "left_semi").select("f").distinct().collect()
        return sure + sorted(of[r["f"]] for r in hit)

    def new_rows(self, name: str, batch: DataFrame, schema: str) -> DataFrame:
        """Rows of the batch, which is read twice, whose key is not stored yet, one for each key."""
        now = self.manifest()[1]
        folders = set(self.may_hold(name, batch, schema, now))
        named = now.get(name, {"data": [], "deletes": []})
        return new_rows(batch, self._rows([d for d in named["data"] if d[0] in folders], named["deletes"], schema), self.keys[name])

    def _counts(self, name: str, view: str, rows: DataFrame, sign: int = 1) -> str:
        return self._written(f"{name}-{view}", self.views[name][view](rows).withColumn("n", (F.col("n") * sign).cast("long")))

    def _read_by(self, name: str, view: str, rows: DataFrame) -> list[str]:
        """The columns of a table that a view reads, as the plan over its files says."""
        leaves = self.views[name][view](rows)._jdf.queryExecution().sparkPlan().collectLeaves()
        scans = [leaves.apply(i).output() for i in range(leaves.size())]
        read = {s.apply(i).name() for s in scans for i in range(s.size())}
        return [c for c in rows.columns if c in read] or rows.columns[:1]

    def _counted(self, name: str, table: dict, schemas: dict[str, str]) -> dict[str, list]:
        """The folders of each view of a table; a view that it doesn't have yet is counted from its rows."""
        if name not in schemas:
            return {}
        had, full = table.get("views", {}), lambda: self._rows(table["data"], table["deletes"], schemas[name])
        return {v: list(had[v]) if v in had else [self._counts(name, v, full())] if table["data"] else [] for v in self.views.get(name, {})}

    def _lost(self, table: dict, entry: dict, schema: str) -> DataFrame:
        """The stored rows that a delete folder takes away."""
        keys = self.spark.read.parquet(entry["folder"]).select(*[F.col(c).alias(f"_{c}") for c in entry["by"]])
        same = F.col("_named") <= entry["upto"]
        for c in entry["by"]:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return self._numbered(table["data"], table["deletes"], schema).join(keys, same, "left_semi").drop("_named")

    def _added_up(self, folders: list[str], by: tuple[str, ...] = ()) -> DataFrame:
        rows = self.spark.read.parquet(*folders)
        rows = rows.repartition(*by) if by else rows
        return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n")).filter("n != 0")

    def view(self, name: str, view: str, schema: str, as_of: dict | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        """The view's counts over all rows of the table, from the publications' counts; ``by``: columns by which the caller groups them further."""
        table = (self.manifest()[1] if as_of is None else as_of).get(name, {"data": [], "deletes": []})
        folders = table.get("views", {}).get(view)
        return self._added_up(folders, by) if folders else self.views[name][view](self._rows(table["data"], table["deletes"], schema))

    def _outnumbers(self, table: dict, entry: dict, schema: str) -> bool:
        """Whether a delete folder has more keys than it leaves rows; by the files' footers."""
        keys = self.spark.read.parquet(entry["folder"]).count()
        return keys > self.REWRITTEN and 2 * keys > self.spark.read.schema(schema).parquet(*[d[0] for d in table["data"]]).count()

    def _rewritten(self, name: str, table: dict, entry: dict, schemas: dict[str, str]) -> dict:
        """The table as the rows that its deletes and this one leave, with their numbers, and no deletes: no later row is as old as these."""
        data = table["data"]
        folder = self._written(name, self._numbered(data, [*table["deletes"], entry], schemas[name]))
        rows = self.spark.read.schema(schemas[name]).parquet(folder)
        return {
            "data": [[folder, min(d[1] for d in data), max(d[2] for d in data)]], "deletes": [], "filters": self._filter(name, folder, schemas),
            "views": {v: [self._counts(name, v, rows)] for v in self.views.get(name, {})},
        }

    def _numbered(self, data: list, deletes: list, schema: str) -> DataFrame:
        """Rows of data folders without those deleted, with the number of the manifest that first named each."""
        rows = self.spark.read.schema(f"{schema}, _named bigint").parquet(*[d[0] for d in data])
        of = F.create_map(*[F.lit(x) for folder, low, _ in data for x in (folder.rsplit("/", 1)[-1], low)])
        rows = rows.withColumn("_named", F.coalesce("_named", of[F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1)].cast("long")))
        for by in {tuple(d["by"]) for d in deletes}:
            keys = [f"_{c}" for c in by]
            gone = self.spark.read.parquet(*[d["folder"] for d in deletes if tuple(d["by"]) == by]).groupBy(*by).agg(F.max("_upto").alias("_upto")).toDF(*keys, "_upto")
            same = F.col("_named") <= F.col("_upto")
            for c, k in zip(by, keys):
                same = same & F.col(c).eqNullSafe(F.col(k))
            rows = rows.join(gone, same, "left_anti")
        return rows

    def _rows(self, data: list, deletes: list, schema: str) -> DataFrame:
        if not data:
            return self.spark.createDataFrame([], schema).limit(0)  # which the optimizer knows to be empty
        newest = max((d["upto"] for d in deletes), default=0)
        old, young = [d for d in data if d[1] <= newest], [d[0] for d in data if d[1] > newest]
        if not old:
            return self.spark.read.schema(schema).parquet(*young)
        rows = self._numbered(old, deletes, schema).drop("_named")
        return rows.unionByName(self.spark.read.schema(schema).parquet(*young)) if young else rows

    def _written(self, name: str, df: DataFrame) -> str:
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(folder, compression=CODEC)
        return folder

    def write(self, name: str, df: DataFrame) -> str:
        """A folder of the table that nothing names until it is published."""
        return self._written(name, df)

    def size(self, folder: str) -> int:
        """Bytes of a folder's files."""
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def _named(self, number: int, tables: dict) -> bool:
        """Whether the manifest with this number is ours: a file that isn't there yet, moved into place at once."""
        hidden, shown = self._path(f"{self.root}/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest-{number:012d}.json")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if shown.toUri().getScheme() not in (None, "file"):
            return self._fs.rename(hidden, shown)  # refused where the number is taken
        as_file = lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:  # a local rename would replace; a link is refused
            self.spark._jvm.java.nio.file.Files.createLink(as_file(shown), as_file(hidden))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _compacted(self, name: str, table: dict, schema: str) -> dict:
        """The table with its smallest data folders merged, where there are too many, and its delete folders too."""
        data, deletes, filters = table["data"], table["deletes"], dict(table["filters"])
        if len(data) > self.FOLDERS:
            by_size = sorted(data, key=lambda d: self.size(d[0]))
            merged, rest = by_size[: len(data) - self.FOLDERS // 2], by_size[len(data) - self.FOLDERS // 2 :]
            one = self._written(name, self._numbered(merged, deletes, schema))
            data = [d for d in data if d in rest] + [[one, min(d[1] for d in merged), max(d[2] for d in merged)]]
            filters |= self._filter(name, one, {name: schema})
        deletes = [d for d in deletes if any(low <= d["upto"] for _, low, _ in data)]
        for by in {tuple(d["by"]) for d in deletes}:
            mine = [d for d in deletes if tuple(d["by"]) == by]
            if len(mine) > self.DELETES:
                keys = self.spark.read.parquet(*[d["folder"] for d in mine]).groupBy(*by).agg(F.max("_upto").alias("_upto"))
                one = {"folder": self._written(f"{name}-deletes", keys), "upto": max(d["upto"] for d in mine), "by": list(by)}
                deletes = [d for d in deletes if tuple(d["by"]) != by] + [one]
        views = {}
        for view, folders in table["views"].items():
            if len(folders) > self.FOLDERS:
                by_size = sorted(folders, key=self.size)
                merged = by_size[: len(folders) - self.FOLDERS // 2]
                folders = [f for f in folders if f not in merged] + [self._written(f"{name}-{view}", self._added_up(merged))]
            views[view] = folders
        return {"data": data, "deletes": deletes, "filters": {d[0]: filters[d[0]] for d in data if d[0] in filters}, "views": views}

    def publish(
        self, appended: dict[str, DataFrame | str], replaced: dict[str, Callable[[DataFrame], DataFrame]] | None = None, schemas: dict[str, str] | None = None, tries: int = 20,
        deleted: dict[str, DataFrame] | None = None, keys: dict[str, list[str]] | None = None, as_of: int | None = None,
    ) -> None:
        """Append tables' rows (or the folder that ``write`` gave for them), delete those with given keys, and put for others what a function makes of their stored rows, all at once.

        ``deleted``: for a table, rows of key columns; a key may be stored again in the same
        publication.  ``as_of``: the manifest from which the caller worked, else the one at
        the start; rows published after it are not deleted, and ``keys``, a table's unique
        key, keeps appended rows out whose key came between.
        """
        schemas = schemas or {}
        start = self.manifest()[0] if as_of is None else as_of
        new = {name: df if isinstance(df, str) else self._written(name, df) for name, df in appended.items()}
        filters = {name: self._filter(name, folder, schemas) for name, folder in new.items()}
        rows_of = lambda name, folder: self.spark.read.schema(schemas[name]).parquet(folder)
        views_of = lambda name: self.views.get(name, {}) if name in schemas else {}
        counts = {name: {v: self._counts(name, v, rows_of(name, folder)) for v in views_of(name)} for name, folder in new.items()}
        gone = {}
        for name, df in (deleted or {}).items():
            folder = self._written(f"{name}-deletes", df.distinct().withColumn("_upto", F.lit(start).cast("long")))
            gone[name] = {"folder": folder, "upto": start, "by": df.columns}
        for _ in range(tries):
            number, tables = self.manifest()
            now = {name: {"data": list(t["data"]), "deletes": list(t["deletes"]), "filters": dict(t.get("filters", {})), "views": t.get("views", {})} for name, t in tables.items()}
            of = lambda name: now.setdefault(name, {"data": [], "deletes": [], "filters": {}, "views": {}})
            for name in {*new, *gone}:
                of(name)["views"] = self._counted(name, of(name), schemas)
            for name, change in (replaced or {}).items():
                folder = self._written(name, change(self._rows(of(name)["data"], of(name)["deletes"], schemas[name])))
                now[name] = {
                    "data": [[folder, number + 1, number + 1]], "deletes": [], "filters": self._filter(name, folder, schemas),
                    "views": {v: [self._counts(name, v, rows_of(name, folder))] for v in views_of(name)},
                }
            for name, entry in gone.items():
                t = of(name)
                if t["data"] and name in schemas and self._outnumbers(t, entry, schemas[name]):
                    now[name] = self._rewritten(name, t, entry, schemas)
                    continue
                if t["data"] and views_of(name):  # the rows are met once for all views
                    counted = sorted({c for v in views_of(name) for c in self._read_by(name, v, rows_of(name, t["data"][0][0]))})
                    lost = self._lost(t, entry, schemas[name]).select(*counted)
                    lost = self.spark.read.schema(lost.schema).parquet(self._written(f"{name}-lost", lost))
                    for v in views_of(name):
                        t["views"][v].append(self._counts(name, v, lost, -1))
                t["deletes"].append(entry)
            for name, folder in new.items():
                t, counted = of(name), counts[name]
                since, full = [d for d in t["data"] if d[2] > start], folder
                if since and name in (keys or {}):
                    others = self._numbered(since, t["deletes"], schemas[name]).filter(F.col("_named") > start)
                    folder = self._written(name, new_rows(rows_of(name, full), others, keys[name]))
                    counted = {v: self._counts(name, v, rows_of(name, folder)) for v in counted}
                t["data"].append([folder, number + 1, number + 1])
                t["filters"] |= {folder: f for f in filters[name].values()}  # of more rows than were left, maybe
                for v, f in counted.items():
                    t["views"][v].append(f)
            for name in [n for n in now if n in schemas]:
                now[name] = self._compacted(name, now[name], schemas[name])
            if self._named(number + 1, now):
                return
        raise RuntimeError("other publications came first each time")

    def upsert(self, name: str, batch: DataFrame, key: list[str], schemas: dict[str, str]) -> None:
        """Rows of the batch replace those with their key; of the batch's own rows with one key the last by all columns stays."""
        rest = [c for c in batch.columns if c not in key]
        last = batch.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*").select(*batch.columns)
        self.publish({name: last}, None, schemas, deleted={name: batch.select(*key)})


def without_keys(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` whose key, nulls being equal, is not among ``keys``."""
    other = keys.select(*by).distinct().toDF(*[f"_{c}" for c in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(other, same, "left_anti")


def duplicates_of(triples: DataFrame, survivors: DataFrame) -> DataFrame:
    """The triples (id and key) whose key no survivor has; ids don't tell triples apart."""
    return without_keys(triples.select("id", *TRIPLE_KEY).distinct(), survivors, TRIPLE_KEY)


VECTOR_OF = ["knowledge_triple_id", "vector_type", "text"]


def vectors_to_delete(gone: DataFrame, stored: DataFrame) -> DataFrame:
    """Which vectors (VECTOR_OF) go with triples: those that no stored triple of the same id still has."""
    stays = without_keys(stored.join(gone.select("id").distinct(), "id", "left_semi"), gone, TRIPLE_KEY)
    return vector_texts(gone).toDF(*VECTOR_OF).distinct().join(vector_texts(stays).toDF(*VECTOR_OF), VECTOR_OF, "left_anti")


def delete_triples(triples: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the triples of ``gone`` (ids, and keys where it has them); vectors go with the last triple of their id."""
    left = without_keys(triples, gone, [c for c in ("id", *TRIPLE_KEY) if c in gone.columns])
    return left, without_ids(vectors, gone.select("id").join(left.select("id"), "id", "left_anti"), "knowledge_triple_id")


def detach_concepts(conceptualizations: DataFrame, ids: DataFrame) -> DataFrame:
    """References to deleted concepts become null."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    return conceptualizations.join(gone, F.col("concept_node_id") == F.col("gone"), "left").withColumn(
        "concept_node_id", F.when(F.col("gone").isNull(), F.col("concept_node_id"))
    ).drop("gone")
