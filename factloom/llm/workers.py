"""What keeps Python workers small: bounded Arrow batches, and memory handed back after each task."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows may be wide (whole texts, token sets), so batches are bounded by bytes; a single larger row is a batch of its own.
BATCH_BYTES = 8 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, unless the session has a bound of its own."""
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """A worker idles for a minute before it ends; what it has freed goes back to the system now."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run):
    """``run``, a generator over Arrow batches, that gives memory back at its end."""

    @functools.wraps(run)
    def lean_run(tables):
        try:
            yield from run(tables)
        finally:
            give_back()

    return lean_run
