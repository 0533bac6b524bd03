"""Sweeps over levels and chunks of records that a second run takes up where the first one stopped.

The results are the ledger: a chunk is done when its folder holds a committed file set, and writing a folder is all or
nothing. What is left to do is found by an anti-join, and nothing is computed twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import for_each
from ..session import pinned

CHUNKS = 16


def chunk_of(record: str, chunks: int):
    return F.pmod(F.xxhash64(F.col(record).cast("string")), F.lit(chunks)).cast("int")


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(level, chunk) of the pieces that are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/level=*/chunk=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    pieces = [tuple(int(p.split("=")[1]) for p in f.getPath().getParent().toString().rsplit("/", 2)[1:]) for f in found]
    return spark.createDataFrame(pieces, "level int, chunk int")


def pending(samples: DataFrame, record: str, levels: Sequence[float], folder: str, chunks: int = CHUNKS) -> DataFrame:
    """(level, chunk) that the sweep still has to compute: those that hold records and are not stored."""
    spark = samples.sparkSession
    every = for_each(samples.select(chunk_of(record, chunks).alias("chunk")).distinct(), spark.createDataFrame([(i,) for i in range(len(levels))], "level int"))
    return every.join(finished(spark, folder), ["level", "chunk"], "left_anti")


def sweep(samples: DataFrame, record: str, levels: Sequence[float], compute: Callable[[DataFrame, int, float], DataFrame], folder: str,
          chunks: int = CHUNKS, at_most: int | None = None) -> DataFrame:
    """Results of `compute(rows of one chunk, level number, level)` for every level and chunk, with level and chunk.

    The list of pieces has chunks x levels entries, both chosen by the caller, so the driver loops over a short
    list. `at_most` stops after that many pieces, as a killed run would.
    """
    spark = samples.sparkSession
    placed = pinned(samples.withColumn("_chunk", chunk_of(record, chunks)))
    left = sorted((r["level"], r["chunk"]) for r in pending(samples, record, levels, folder, chunks).collect())
    for level, chunk in left[:at_most]:
        rows = placed.where(F.col("_chunk") == chunk).drop("_chunk")
        compute(rows, level, float(levels[level])).write.mode("overwrite").parquet(f"{folder}/level={level}/chunk={chunk}")
    return stored(spark, folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """All results so far."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/level=*/chunk=*")
