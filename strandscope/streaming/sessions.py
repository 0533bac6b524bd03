"""Sessions of an event stream, kept in a table with one row per key and session.

Events may arrive more than once; they are dropped by their id as long as the watermark allows. Sessions are
state of the stream until the watermark has passed their gap; then they are merged into the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pinned

BUCKETS = 16


def sessions(events: DataFrame, time: str, key: str, event_id: str, value: str, gap: str, lateness: str) -> DataFrame:
    """(key, started, ended, n, total) of every session: events of a key no further apart than `gap`.

    For a stream the rows of a session come once, when the watermark has passed it; an event that comes again within
    `lateness` of its first arrival counts once.
    """
    known = events.select(key, time, event_id, value).where(F.col(time).isNotNull())
    if known.isStreaming:
        known = known.withWatermark(time, lateness).dropDuplicatesWithinWatermark([event_id])
    else:
        known = known.dropDuplicates([event_id])
    span = F.session_window(time, gap)
    out = known.groupBy(key, span.alias("span")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(time).alias("ended"))
    return out.select(key, F.col("span.start").alias("started"), "ended", "n", "total")


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def merged(rows: DataFrame, target: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Replaces the rows of the same keys in a bucketed table and adds the others.

    Only the buckets that the rows fall into are read and written. Merging the same rows again changes nothing, so a batch
    that is replayed after a lost driver is harmless.
    """
    spark = rows.sparkSession
    fresh = pinned(rows.withColumn("bucket", _bucket(keys, buckets)))
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    if exists(spark, target):
        held = spark.read.schema(fresh.schema).parquet(target).where(F.col("bucket").isin(touched))
        fresh = pinned(held.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh))
    fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)


def keep_sessions(events: DataFrame, target: str, checkpoint: str, keys: Sequence[str], **how) -> None:
    """Follows a stream of events until its backlog is done and merges the sessions that have closed into `target`."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        merged(batch, target, keys)

    query = (sessions(events, **how).writeStream.outputMode("append").foreachBatch(merge)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
