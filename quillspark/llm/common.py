"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shipping import ship

from . import textkernel

#: Arrow batches stay this small, so a worker holds a few MB of text at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python workers, which get this package's code. Smaller bounds that are set already stay."""
    ship(spark)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(key).lower().removesuffix("b")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def tidied(run: Callable) -> Callable:
    """A batch function that returns its worker's free memory when it ends: workers are reused by later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            textkernel.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own where it is unset, which only a local master allows."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths of the intermediate tables that still stand, for each open scope; the first one is open all the time.
_scopes: list[list[str]] = [[]]


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, kept in the open scope and deleted when the driver's JVM ends at the latest."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _scopes[-1].append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what exists can be marked
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, path: str, **options) -> DataFrame:
    """Write ``df`` to a path of :func:`fresh_path` and read it back.

    The shuffle files behind it are of no use then: Spark deletes them as the write ends, on all executors. A lost
    executor costs no recomputation, for the table is in the shared folder.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` by way of a table in the shared folder: later stages no longer depend on its lineage."""
    path = fresh_path(df.sparkSession, tag)
    out = written(df, path, compression="zstd")
    out._staged = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`fresh_path` now."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    for scope in _scopes:
        if path in scope:
            scope.remove(path)


def unstage(*dfs: DataFrame) -> None:
    """Delete what :func:`staged` wrote for these, when nothing reads it any more."""
    for df in dfs:
        delete(df.sparkSession, df._staged)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Intermediate tables made inside are deleted at the end: for a caller that has written its result elsewhere by then.

    Tables of other scopes, such as those behind a lazy result made before, stay.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in list(_scopes[-1]):
            delete(spark, path)
        _scopes.pop()


def partition_keys(n: int) -> np.ndarray:
    """For each of n partitions a number that Spark's hash partitioning deals to it, so that buckets and partitions match one to one."""
    found, at = np.full(n, -1, np.int64), 0
    while (found < 0).any():
        numbers = np.arange(at, at + 8 * n, dtype=np.int64)
        place = _spark_hash(numbers).astype(np.int64) % n
        first = np.unique(place, return_index=True)
        new = found[first[0]] < 0
        found[first[0][new]] = numbers[first[1][new]]
        at += 8 * n
    return found


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of a bigint (Murmur3 with seed 42), as int32."""
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = np.full(len(x), 42, np.uint32)
    for word in (x.astype(np.uint64).astype(np.uint32), (x.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)):
        k = turn(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


#: A key that holds at least this share of the rows counts as hot, so there are at most HOT_KEYS of them.
HOT_KEYS, SALTS = 1000, 64


def salted_join(rows: DataFrame, kinds: DataFrame, keys: list[str], count: str, skip: Column | None = None) -> DataFrame:
    """``rows`` left-joined to ``kinds`` (one row for each value of ``keys``; ``count``: how many of ``rows`` have it).

    The rows of a hot value are dealt over SALTS places, to each of which its row of ``kinds`` goes; only the hot values
    themselves, at most HOT_KEYS by their definition, are broadcast. Rows for which ``skip`` holds match nothing and are dealt evenly.
    """
    least = max(-(-(kinds.agg(F.sum(count)).first()[0] or 0) // HOT_KEYS), 2)
    hot = kinds.where(F.col(count) >= least).select(*keys, F.lit(True).alias("_hot"))
    place = F.monotonically_increasing_id()
    salt = F.when(F.col("_hot"), F.pmod(place, F.lit(SALTS))).otherwise(F.lit(0))
    if skip is not None:
        salt = F.when(skip, -1 - F.pmod(place, F.lit(1 << 20))).otherwise(salt)
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_hot")
    places = F.when(F.col(count) >= least, F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    return salted.join(kinds.withColumn("_salt", F.explode(places)), [*keys, "_salt"], "left").drop("_salt")


def width(spark: SparkSession) -> int:
    """Partitions for hash-dealt Python stages."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")
