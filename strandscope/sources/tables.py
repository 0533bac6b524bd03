"""Evaluation, threshold and split tables with declared columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the tables that are exchanged as CSV.
EVALUATION = ("record string, prediction string, lead string, placement string, n_samples int, window_start int, "
              "window_end int, snr_raw double, pearson_r double, snr_aligned double, shift double, offset double, missing string")
THRESHOLDS = ("judge string, input string, class string, threshold_logit double, n_pos int, n_neg int, auroc_fold9 double, "
              "device string, source string")
SPLITS = "record string, split string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").option(
        "enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with a header; refuses to overwrite."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_split(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("dev", "eval")) -> DataFrame:
    """Split of each record; a value that is not allowed stops the job."""
    rows = read_csv(spark, path, SPLITS)
    return rows.withColumn("split", F.when(F.col("split").isin(*allowed), F.col("split")).otherwise(
        F.raise_error(F.concat(F.lit("unknown split "), F.col("split"))).cast("string")))


def thresholds_for(rows: DataFrame, judge: str, kind: str, classes: list[str]) -> DataFrame:
    """Thresholds of one classifier and input kind; all classes must be there."""
    mine = rows.filter((F.col("judge") == judge) & (F.col("input") == kind)).select(
        "class", F.col("threshold_logit").alias("thr"))
    mine = mine.filter(F.col("class").isin(classes))
    lacking = sorted(set(classes) - {r["class"] for r in mine.select("class").distinct().collect()})
    if lacking:
        raise ValueError(f"no {kind} thresholds of {judge} for {lacking}")
    return mine


def append_quality(rows: DataFrame, path: str) -> None:
    """Quality rows are only ever appended."""
    rows.write.mode("append").parquet(path)
