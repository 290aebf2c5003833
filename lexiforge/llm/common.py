"""Plumbing that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path, shared_folder, stored  # noqa: F401

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


cut = stored
shared_dir = shared_folder


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan can reach any more, before a job that writes many new ones."""
    for _ in range(3):  # Spark's cleaner learns of unreachable shuffles from the collector, and works beside it
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def give_back() -> None:
    """Return what a Python worker has freed to the system: it stays alive between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: Rows of long text that go to a Python worker at a time.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_ROWS`` rows in this session: texts are long, and both sides keep whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: A key that holds more than one in so many rows is joined by broadcast: there are at most so many of them.
HEAVY_SHARE = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``left`` with the columns of ``right``, a row a key at most, that has the rows of each key in ``count``.

    Keys with more than a ``HEAVY_SHARE``-th of all rows, of which there are at most that many, are joined by broadcast, so
    that no task gets all rows of one key; the others by the usual way.  Rows without a match keep nulls.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) > total / HEAVY_SHARE
    big = right.filter(heavy).limit(HEAVY_SHARE)
    marked = left.join(F.broadcast(big.withColumn("is_heavy", F.lit(True))), keys, "left")
    rest = marked.filter("is_heavy is null").select(*left.columns).join(right.filter(~heavy), keys, "left")
    names = [*left.columns, *[c for c in right.columns if c not in keys]]
    return marked.filter("is_heavy").select(*names).union(rest.select(*names))
