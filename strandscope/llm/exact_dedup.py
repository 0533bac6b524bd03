"""Exact deduplication by sorting contents (DataFrame functions only).

Normalised texts are range-partitioned over sampled splitters and sorted, so that equal texts are
neighbours; a window compares each row with its neighbour byte for byte and keeps the smallest
identifier of a run. Splitters hold just the first HEAD characters, so that no whole text reaches the
driver, and a slice number: a text that a third of all rows share then falls into many ranges instead
of one. One short row per slice, not per document, ties the slices of a text together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import filtered, pinned, work_columns

#: How many slices the copies of one text are dealt to.
SLICES = 256
#: Characters of a text that a splitter may hold.
HEAD = 48


def normalised(text):
    """White space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, slices: int = SLICES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null and empty texts are equal to each other. `keep_id` is the smallest doc_id of the group; a
    null doc_id sorts last and stays only if its whole group has none. Of rows that repeat both
    doc_id and text one is kept. Other columns of the input are ignored; no rows give no rows.
    """
    rows = work_columns(docs).select(
        "doc_id", normalised(F.col("text")).alias("content"), F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"))
    rows = rows.withColumn("head", F.substring("content", 1, HEAD))
    run = Window.partitionBy("head", "slice", "content")
    in_order = run.orderBy(F.col("doc_id").asc_nulls_last())
    compared = rows.repartitionByRange("head", "slice").select(
        "doc_id", "slice",
        F.row_number().over(in_order).alias("place"),
        F.count(F.lit(1)).over(run).alias("in_slice"),
        F.sha2(F.col("content").cast("binary"), 256).alias("text_sha256"),
    )
    runs = pinned(compared)
    firsts = runs.where("place = 1").select("text_sha256", "slice", "doc_id", "in_slice")
    groups = firsts.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("in_slice").alias("group_size"))
    spread = firsts.select("text_sha256", "slice").join(groups, "text_sha256")
    return runs.join(spread, ["text_sha256", "slice"]).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"),
        "text_sha256")


def keep_first(docs: DataFrame, slices: int = SLICES) -> DataFrame:
    """One row of each group of equal texts, with all its columns, rows with a null or repeated doc_id among them."""
    return filtered(docs, lambda texts: exact_groups(texts, slices).where("not kept"))


SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM {documents})
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content)
"""
