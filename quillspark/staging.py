"""Tables written to the shared folder and reread, where a plan must not be computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of ``spark.checkpoint.dir``, deleted when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-files-")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/files-{uuid.uuid4().hex}")
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(p)
    store.deleteOnExit(p)
    return str(p.toString())


def staged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` by way of a table under ``spark.checkpoint.dir``, perhaps in folders by some columns; deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/rows"
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
