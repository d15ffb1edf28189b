"""Durable intermediate results, which outlive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillon-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in a file system that Spark can write, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Deletes all durable results of this session. Tables that were made from them can't be read any more."""
    remove(spark, shared_folder(spark))


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with gapless ranks from 1 over all rows, by ranges of the order and without one task for all of them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted_.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # A row for each partition.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.broadcast(counts.select("_part", (before - F.col("_first") + 1).alias("_shift")))
    return sorted_.withColumn("_part", part).join(shift, "_part").withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).drop("_at", "_part", "_shift")
