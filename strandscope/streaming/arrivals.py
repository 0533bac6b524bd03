"""Incremental forms of the append-per-record jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_rows(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A file stream over a growing folder of Parquet parts."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _has_parts(spark: SparkSession, target: str) -> bool:
    """Has a batch been written yet?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/batch=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def append_once(stream: DataFrame, key: str, target: str, checkpoint: str,
                compute: Callable[[DataFrame], DataFrame]) -> None:
    """Process what has arrived and append one result per key; keys already there are skipped.

    A replayed batch rewrites its own partition, so a lost driver neither doubles nor
    drops a record. Runs until the backlog is done.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch
        if _has_parts(spark, target):
            done = spark.read.parquet(target).filter(F.col("batch") != batch_id).select(key)
            fresh = batch.join(done, key, "left_anti")
        result = compute(fresh).withColumn("batch", F.lit(batch_id))
        (result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target))

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def running_summary(stream: DataFrame, time: str, key: str, value: str, window: str, lateness: str,
                    target: str, checkpoint: str) -> None:
    """Counts and sums per key and time window, each appended when its window closes."""
    out = (stream.withWatermark(time, lateness).groupBy(F.window(time, window), key)
           .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
           .select(F.col("window.start").alias("start"), key, "n", "total"))
    query = (out.writeStream.outputMode("append").format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def resume_missing(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a restarted job still has to do."""
    return inputs.join(done.select(key), key, "left_anti")
