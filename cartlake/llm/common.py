"""Small helpers shared by the corpus operators: table access, written
intermediates in the cluster's shared folder, per-row Arrow access, the
train/held-out split."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlake.plans.session import scratch_path, short_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared checkpoint folder and read it back:
    cuts lineage (a lost executor re-reads files instead of recomputing) and
    lets several consumers share one computation. The write's shuffle files go
    with it, they would else stay until the driver collects its garbage."""
    spark = df.sparkSession
    short_batches(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_fold(mod: int, rest: int, id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod ``mod`` == ``rest``; a null id is in no fold."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % mod) == rest, F.lit(False))


def texts(col) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return [b"" if x is None else x for x in col.cast("binary").to_pylist()]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most 512 rows and about 8 MB."""
    step = max(1, min(512, (batch.num_rows << 23) // (batch.nbytes + 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def per_worker(name: str, make):
    """``make()`` once per Python worker process; later tasks of the worker get
    the same object (functions pickled by value have no lasting globals). A
    worker keeps one such object only."""
    held = vars(sys.modules.setdefault("_cartlake_worker", ModuleType("_cartlake_worker"))).setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def give_back() -> None:
    """Give freed memory back to the system: workers live on, and several
    share an executor's memory."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):       # another C library: nothing to trim
        pass


def tidy(run):
    """A batch function that gives freed memory back when its task ends."""
    def tidied(batches):
        yield from run(batches)
        give_back()
    return tidied


def ship(module: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy
    of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
