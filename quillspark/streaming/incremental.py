"""Incremental forms of the batch operators on Structured Streaming.

The batch pipeline reruns safely: known records are only relinked, decisions survive, the log is appended to. The
same properties hold here per micro-batch. A batch is written to a folder of its own, ``run=<query>/batch=<number>``, and overwrites it:
when Spark replays a batch after a failure, the folder gets the same rows again and the target holds every batch once.
The query's id comes from its checkpoint, so a new checkpoint never overwrites what an older one wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Folders of a target by the hash of the key.
BUCKETS = 64


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key and event-time window; rows later than the watermark are left out."""
    at = events.withColumn("_at", F.col(time).cast("timestamp"))
    return at.withWatermark("_at", late).groupBy(F.window("_at", size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def _run(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint when it began."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the target does not have yet, one a key. Replaying a batch adds nothing.

    The target is also foldered by a hash of the key: a batch looks its keys up in the folders of its own hashes only,
    and never in its own earlier attempt. Rows with a null key are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = _run(spark, checkpoint)
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("bucket", bucket)
        if _exists(spark, target):
            own = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS
            before = _increments(spark, target, batch.schema).where(F.col("bucket").isin(own) & ~((F.col("run") == run) & (F.col("batch") == number)))
            fresh = fresh.join(before.select(key), key, "left_anti")
        fresh.select(*batch.columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _increments(spark: SparkSession, target: str, schema) -> DataFrame:
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields]
    return spark.read.schema(", ".join([*columns, "run string", "batch bigint", "bucket int"])).parquet(target)


def appended(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows that batches have written to a target, which may not exist yet."""
    if not _exists(spark, target):
        return spark.createDataFrame([], schema)
    return _increments(spark, target, schema).select(*schema.names)


def for_each(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch operator to every micro-batch and writes its rows, those of a replayed batch once."""

    def write(batch: DataFrame, number: int) -> None:
        run = _run(batch.sparkSession, checkpoint)
        step(batch).write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
