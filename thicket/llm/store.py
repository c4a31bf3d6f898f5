"""Intermediate tables in the shared folder, and small helpers that every operator uses.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` (read from the
session; a local folder is used only where the setting is absent, as in tests)
and reading it back.  A table survives lost executors and is dropped as soon as
the operator no longer needs it; what a returned DataFrame still reads is
removed when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Local sessions without a shared folder (tests) write here.
LOCAL_ROOT = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL_ROOT).rstrip("/")


#: Tables and tokenizers that a worker keeps between tasks.  Stages that do not use them let go of them first.
KEPT: list[dict] = []


def forget() -> None:
    for table in KEPT:
        table.clear()


def _give_back() -> None:
    """Free memory goes back to the system: workers are reused, and stages differ in what they need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run, keeps_tables: bool = False):
    """The task function ``run`` of ``mapInArrow``: tables that it does not use go first, free memory goes back at its end."""

    def task(batches):
        if not keeps_tables:
            forget()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


#: Bytes of an Arrow batch: texts are long, and a batch exists in the JVM and in Python at once.
ARROW_BYTES = 4 << 20
#: Bytes of text that a task works on at a time.
PART_BYTES = 1 << 20


def sub_batches(batches, most: int = PART_BYTES):
    """Batches cut where their strings reach about ``most`` bytes (one long text may exceed it)."""
    for b in batches:
        size = np.full(b.num_rows, 8, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type):
                size += pa.compute.fill_null(pa.compute.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(size), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to


#: Settings of the workers' C library: few arenas, so that what one thread frees another can use.
WORKER_SETTINGS = {"MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package (clusters install it), and bound Arrow batches by bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now and not 0 < int(now.rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    env = spark.sparkContext.environment
    for name, value in WORKER_SETTINGS.items():
        env.setdefault(name, value)
    now = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _PACKAGE_ROOT not in now.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_PACKAGE_ROOT, now) if x)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """A folder of its own under the shared root."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))
        self.release()

    def release(self) -> None:
        """Lets Spark's cleaner remove shuffle files that no live plan refers to."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


#: log2 of the bits of a runtime filter: 4 MB, whatever the input.
FILTER_BITS = 25


def runtime_filter(keys: DataFrame, bits: int = FILTER_BITS):
    """Broadcast bitmap of fixed size over a long column ``k``: a superset test.

    The bits are OR-ed together on the executors; at most ``2**bits / 64`` words
    reach the driver, however many keys there are.  A full bitmap passes
    everything, which costs speed, never results: all users check exactly later.
    """
    spark = keys.sparkSession
    words = (
        keys.select((F.col("k").bitwiseAND(F.lit((1 << bits) - 1))).alias("b"))
        .groupBy(F.shiftright("b", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("m"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return spark.sparkContext.broadcast(table.view(np.uint64))


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys a broadcast bitmap of ``runtime_filter`` lets through."""
    b = keys & np.uint64(len(table) * 64 - 1)
    return ((table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)).astype(bool)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns of any name cannot clash later."""
    return df.select(*[F.col(f"`{n}`") for n in names])
