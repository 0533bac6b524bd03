"""Signals derived from the given tables, shared by the query modules.

`events` gives one series per user: the day number is the sample index and the summed
value of the day the sample. A second reading of the same series is quantised, has
some days dropped and some turned into NaN. At most one row per user and calendar day
remains, whatever the number of events of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

FIRST_DAY = 19723  # day number of 2024-01-01

DAILY_SQL = """
daily AS (SELECT user_id AS record, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS t,
                 round(sum(value), 4) AS mv FROM events GROUP BY 1, 2)"""

READ_SQL = DAILY_SQL + """,
reading AS (SELECT record, t, CASE WHEN (t + record) % 11 = 5 THEN CAST('nan' AS DOUBLE)
                              ELSE floor(mv / 10) * 10 END AS mv
            FROM daily WHERE (t + record) % 7 <> 3),
pairs AS (SELECT coalesce(d.record, r.record) AS record, coalesce(d.t, r.t) AS t, d.mv AS ref,
                 CASE WHEN isnan(r.mv) THEN NULL ELSE r.mv END AS est
          FROM daily d FULL JOIN reading r ON d.record = r.record AND d.t = r.t)"""


def day_index(ts="ts"):
    return (F.unix_date(F.to_date(ts)) - FIRST_DAY).cast("int")


def hour_index(ts="ts"):
    """Whole hours since 2024-01-01; no time zone is involved."""
    return (F.unix_date(F.to_date(ts)).cast("bigint") - FIRST_DAY) * 24 + F.hour(ts)


def day_fraction(ts="ts"):
    """Days since 2024-01-01 with their fraction."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), F.col(ts)).cast("double")
    return ((F.unix_date(F.to_date(ts)) - FIRST_DAY) * 86400 + seconds) / 86400.0


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .groupBy(F.col("user_id").alias("record"), day_index().alias("t"))
            .agg(F.round(F.sum("value"), 4).alias("mv")))


def reading(series: DataFrame) -> DataFrame:
    mark = F.col("t") + F.col("record")
    return series.filter(mark % 7 != 3).withColumn(
        "mv", F.when(mark % 11 == 5, F.lit(float("nan"))).otherwise(F.floor(F.col("mv") / 10) * 10.0))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
