"""Reading the given tables and pinning intermediate rows in the shared folder."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, pinned

__all__ = ["documents", "filtered", "pinned", "released", "shared_folder", "table", "tied", "work_columns", "written"]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor and the driver can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"

FILE_ROWS = 20_000


def filtered(docs: DataFrame, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of `docs`, with all their columns, that `gone` does not name.

    `gone` gets (doc_id, text) and returns a table whose doc_id column names rows that leave. Each row is
    decided by itself: where ids are null or repeat, the rows are sorted by doc_id and written to the shared
    folder with ids of their own, in the same order. Rows without id come last, so they never stand for
    a row that has one.
    """
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    if ids.where("doc_id is null or n > 1").isEmpty():
        named, own = docs, docs["doc_id"].cast("long")
        texts = work_columns(docs)
    else:
        placed = written(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("place")))
        order = [F.col("row.doc_id").cast("long").asc_nulls_last(), F.col("place")]
        named = written(placed.orderBy(*order).select("row", F.monotonically_increasing_id().alias("own")))
        own, texts = named["own"], named.select(F.col("own").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    lost = gone(texts).select(F.col("doc_id").alias("gone_id"))
    left = named.join(lost, own == lost["gone_id"], "left_anti")
    return left if named is docs else left.select("row.*")


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` as a table in the shared folder. Unlike a checkpoint it does not carry the constraints that
    the optimiser has inferred, whose number would double in every round of a loop. `rows`, a bound on
    its size where one is known, keeps a small table from being cut into many files."""
    folder = shared_folder(df.sparkSession, "round")
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def released(spark: SparkSession) -> None:
    """Between the rounds of a loop: lets Spark's cleaner remove shuffle files, broadcasts and checkpoints
    of rounds that nothing refers to any more (it acts when the driver collects its garbage)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def work_columns(docs: DataFrame) -> DataFrame:
    """Just (doc_id, text): whatever other columns a table has cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def tied(rows: DataFrame, keys: list[str], member: str, slices: int = 256) -> DataFrame:
    """`rows` plus (`first`, `members`): the smallest `member` and the row count of each group of equal keys.

    Rows meet their group's summary on (keys, slice of the member), so a group that holds a third of
    all rows is spread over `slices` tasks; per key only its slices meet. `rows` is read twice.
    """
    cut = F.pmod(F.xxhash64(member), F.lit(slices)).alias("_slice")
    parts = rows.groupBy(*keys, cut).agg(F.min(member).alias("_first"), F.count(F.lit(1)).alias("_n"))
    totals = parts.groupBy(*keys).agg(F.min("_first").alias("first"), F.sum("_n").alias("members"))
    spread = parts.drop("_first", "_n").join(totals, keys)
    return rows.withColumn("_slice", cut).join(spread, [*keys, "_slice"]).drop("_slice")
