"""A table of scores that outlives a job, kept per tag of the model that made them.

Every store writes a whole new version beside the old ones; a version counts once Spark has committed it,
and readers take the newest one that does. A job that dies while it writes changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import cached, refreshed
from ..session import pinned


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def load_scores(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Scores stored under `tag`; none where the newest version has no such tag, or there is no version."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, tag string").parquet(f"{path}/version={versions[-1]}")
    return rows.where(F.col("tag") == tag).drop("tag")


def store_scores(scores: DataFrame, path: str, tag: str) -> None:
    """Writes the scores of `tag` as the newest version; those of other tags are not carried over."""
    versions = _versions(scores.sparkSession, path)
    number = versions[-1] + 1 if versions else 0
    scores.withColumn("tag", F.lit(tag)).write.mode("overwrite").partitionBy("tag").parquet(f"{path}/version={number}")


def scored(inputs: DataFrame, path: str, tag: str, score: Callable[[DataFrame], DataFrame], schema: str, key: str = "key",
           digest: str = "sha1") -> DataFrame:
    """Scores of all inputs (key, digest, ...): what the cache holds for the same digest under this tag, the rest from `score`.

    `score` gets the inputs that are new, have changed or belong to another tag, and returns rows of `schema`.
    """
    held = load_scores(inputs.sparkSession, path, tag, schema)
    _, misses = cached(inputs, held, key, digest)
    misses = pinned(misses)
    if not misses.isEmpty():
        held = pinned(refreshed(held, score(misses), key))
        store_scores(held, path, tag)
    return inputs.select(key, digest).join(held, [key, digest])
