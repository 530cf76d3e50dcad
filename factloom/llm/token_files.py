"""Token ids in flat binary files with 64-bit document offsets.

A shard is three flat little-endian files that can be memory-mapped: ``.ids``
(unsigned 16-bit integers where the vocabulary allows it, else 32-bit), ``.off``
(64-bit offsets of each document's first id, and the end) and ``.doc`` (64-bit
identifiers).  Shards follow each other in ascending doc_id order: documents are
dealt by range and sorted, and each task writes a shard under a name of its own,
so a repeated task never touches a file that was counted.  A shard's base, the
number of ids in all shards before it, is a prefix sum over the shards' totals.

Null text is empty, and then a document is its end id alone.  Rows that share a
doc_id are written one after the other.  A row without doc_id comes first, with
identifier -2**63.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import new_path, written
from .wordpieces import batches, encoder
from .workers import bounded_batches, lean

NO_ID = -(2**63)
SHARD_SCHEMA = "shard string, first_id bigint, n_docs bigint, n_tokens bigint, itemsize int"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _write_shards(base: str, tokenizer: str, end_id: int, shard_bytes: int):
    def run(tables):
        store, root = _filesystem(base)
        words = encoder(tokenizer)
        end = np.array([end_id], words.dtype).tobytes()

        def rows():
            for t in tables:
                yield from zip(t.column(0).to_pylist(), t.column(1).to_pylist())

        # Each batch goes to the open shard's file at once; only its offsets stay in memory.
        shard = None

        def closed():
            shard["out"].close()
            for kind, values in (("off", shard["off"]), ("doc", shard["doc"])):
                with store.open_output_stream(f"{root}/{shard['name']}.{kind}") as f:
                    f.write(np.array(values, "<i8").tobytes())
            return pa.RecordBatch.from_pydict({
                "shard": [shard["name"]], "first_id": pa.array([shard["doc"][0]], pa.int64()),
                "n_docs": pa.array([len(shard["doc"])], pa.int64()), "n_tokens": pa.array([shard["off"][-1]], pa.int64()),
                "itemsize": pa.array([words.dtype.itemsize], pa.int32()),
            })

        for group in batches(rows(), lambda r: len(r[1] or "")):
            if shard is None:
                name = uuid.uuid4().hex
                shard = {"name": name, "out": store.open_output_stream(f"{root}/{name}.ids"), "off": [0], "doc": []}
            for (doc_id, _), ids in zip(group, words.encode([t for _, t in group])):
                shard["out"].write(ids)
                shard["out"].write(end)
                shard["off"].append(shard["off"][-1] + len(ids) // words.dtype.itemsize + 1)
                shard["doc"].append(NO_ID if doc_id is None else doc_id)
            if shard["off"][-1] * words.dtype.itemsize >= shard_bytes:
                yield closed()
                shard = None
        if shard is not None:
            yield closed()
        words.forget()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, partitions: int | None = None, shard_bytes: int = 64 << 20) -> tuple[str, DataFrame]:
    """Write the shards; gives their folder and (shard, first_id, n_docs, n_tokens, itemsize, base)."""
    from pyarrow import fs

    spark = docs.sparkSession
    bounded_batches(spark)
    base = new_path(spark, "tokens")
    store, root = _filesystem(base)
    store.create_dir(root, recursive=True)
    assert store.get_file_info(root).type == fs.FileType.Directory
    rows = docs.select("doc_id", "text")
    n = partitions or max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    shards = written(ordered.mapInArrow(lean(_write_shards(base, tokenizer, end_id, shard_bytes)), SHARD_SCHEMA), "token-shards")
    # Shards cut within a run of one doc_id can't be told apart by it: then their order is that of their names.
    order = Window.orderBy("first_id", "shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).cast("long"))
    return base, based


def _mapped(store, path: str, dtype):
    """Memory-mapped where the store has local files, else read."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _read_shards(base: str):
    def run(tables):
        store, root = _filesystem(base)
        for t in tables:
            for name, first, itemsize in zip(t.column("shard").to_pylist(), t.column("base").to_pylist(), t.column("itemsize").to_pylist()):
                ids = _mapped(store, f"{root}/{name}.ids", f"<u{itemsize}")
                off = _mapped(store, f"{root}/{name}.off", "<i8")
                doc = _mapped(store, f"{root}/{name}.doc", "<i8")
                crc = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4")) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc, pa.int64(), mask=np.asarray(doc) == NO_ID),
                        pa.array(np.asarray(off[:-1]) + first),
                        pa.array(np.diff(off)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_tokens(base: str, shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = shards.sparkSession
    dealt = shards.select("shard", "base", "itemsize").repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(_read_shards(base), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
