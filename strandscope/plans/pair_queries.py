"""Paired comparison, run summaries, prefix matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..operators import pairing
from .registry import query, table

# Two "runs": net line price at the booked discount and at a discount lowered by 0.03.
RUNS_SQL = """
a AS (SELECT l_orderkey AS record, l_linenumber AS lead,
             CASE WHEN l_discount > 0.095 THEN CAST('nan' AS DOUBLE)
                  ELSE round(l_extendedprice * (1 - l_discount), 6) END AS m
      FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT l_orderkey AS record, l_linenumber AS lead,
             CASE WHEN l_tax > 0.075 THEN CAST('inf' AS DOUBLE)
                  ELSE round(l_extendedprice * (1 - l_discount * 1.5) + l_quantity * 100, 6) END AS m
      FROM lineitem),
p AS (SELECT a.record, a.lead, a.m AS a, b.m AS b, b.m - a.m AS delta
      FROM a JOIN b ON a.record = b.record AND a.lead = b.lead
      WHERE NOT isnan(a.m) AND NOT isinf(a.m) AND NOT isnan(b.m) AND NOT isinf(b.m))
"""


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("lead")]
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 6)
    other = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount") * 1.5) + F.col("l_quantity") * 100, 6)
    a = line.filter(F.col("l_returnflag") != "R").select(
        *keys, F.when(F.col("l_discount") > 0.095, F.lit(float("nan"))).otherwise(net).alias("snr_raw"))
    b = line.select(*keys, F.when(F.col("l_tax") > 0.075, F.lit(float("inf"))).otherwise(other).alias("snr_raw"))
    return a, b


def _rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("pair_runs_delta", f"WITH {RUNS_SQL} SELECT record, lead, a, b, round(delta, 6) AS delta FROM p")
def pair_runs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pairing.pair_runs(*_runs(spark, sf_dir)), ["delta"], 6)


@query("pair_runs_summary", f"""WITH {RUNS_SQL}
SELECT count(DISTINCT record) AS n_records, count(*) AS n_leads,
       round(median(a), 4) AS a_median, round(avg(a), 4) AS a_mean, round(min(a), 4) AS a_min,
       round(median(b), 4) AS b_median, round(avg(b), 4) AS b_mean, round(min(b), 4) AS b_min,
       round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_improved,
       count(*) FILTER (WHERE round(delta, 6) <= -1.0) AS n_worse
FROM p""")
def pair_runs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = pairing.pair_runs(*_runs(spark, sf_dir)).withColumn("delta", F.round("delta", 6))
    out = pairing.pair_summary(paired)
    out = _rounded(out, ["a_median", "a_mean", "a_min", "b_median", "b_mean", "b_min"])
    return out.withColumn("frac_improved", F.round("frac_improved", 6))


@query("pair_runs_worse", f"""WITH {RUNS_SQL}
SELECT record, lead, a, b, round(delta, 6) AS delta FROM p WHERE round(delta, 6) <= -500.0""")
def pair_runs_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = pairing.pair_runs(*_runs(spark, sf_dir)).withColumn("delta", F.round("delta", 6))
    return pairing.worse_rows(paired, -500.0)


@query("run_summary_rollup", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS record, value AS x, event_type = 'error' AS missing FROM events),
t AS (SELECT record, x, missing FROM e UNION ALL SELECT '*', x, missing FROM e)
SELECT record, count(*) FILTER (WHERE NOT missing) AS n_leads, count(*) FILTER (WHERE missing) AS n_missing,
       round(avg(x) FILTER (WHERE NOT missing), 6) AS snr_raw_mean,
       round(median(x) FILTER (WHERE NOT missing), 6) AS snr_raw_median
FROM t GROUP BY record""")
def run_summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("record"), F.col("event_type").alias("lead"),
        F.col("value").alias("snr_raw"), (F.col("event_type") == "error").alias("missing"))
    return _rounded(pairing.run_summary(events), ["snr_raw_mean", "snr_raw_median"], 6)


@query("record_spread", """
SELECT user_id AS record, round(median(value), 6) AS snr_rec_median, round(min(value), 6) AS snr_rec_min
FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def record_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), F.col("value").alias("snr_raw"),
        F.when(F.col("event_type") == "error", " True ").otherwise("false").alias("missing"))
    return _rounded(pairing.record_spread(events), ["snr_rec_median", "snr_rec_min"], 6)


NAMES_SQL = """
gt AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') || '-' || lower(p_type) AS name FROM part
       UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part
       UNION SELECT DISTINCT p_type || '-unknown' FROM part),
pred AS (SELECT DISTINCT replace(lower(p_name), ' ', '-') || '-' || lower(p_type) || '-' || p_size AS name FROM part
         UNION SELECT DISTINCT replace(lower(p_name), ' ', '-') || '-' || lower(p_type) FROM part WHERE p_size < 25)
"""


@query("prefix_match", f"""WITH {NAMES_SQL},
c AS (SELECT gt.name AS name, pred.name AS cand,
             CASE WHEN pred.name = gt.name THEN 0 ELSE 1 END AS kind
      FROM gt JOIN pred ON pred.name = gt.name OR starts_with(pred.name, gt.name || '-')),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY kind, cand) AS rn FROM c)
SELECT name, cand AS match, kind = 1 AS by_prefix FROM r WHERE rn = 1""")
def prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    stem = F.concat_ws("-", F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")), F.lower("p_type"))
    wanted = (part.select(stem.alias("name"))
              .union(part.select(F.split("p_name", " ")[0]))
              .union(part.select(F.concat("p_type", F.lit("-unknown")))).distinct())
    offered = (part.select(F.concat_ws("-", stem, F.col("p_size").cast("string")).alias("pred"))
               .union(part.filter("p_size < 25").select(stem)).distinct())
    return pairing.match_by_prefix(wanted, offered, "name", "pred")


@query("finite_filter", """
SELECT l_returnflag AS flag, count(*) AS n_rows,
       count(*) FILTER (WHERE l_tax > 0) AS n_finite,
       round(avg(ln(l_tax)) FILTER (WHERE l_tax > 0), 6) AS mean_log_tax
FROM lineitem GROUP BY l_returnflag""")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = F.col("l_tax")
    log_tax = F.when(tax > 0, F.log(tax)).otherwise(F.lit(float("-inf")))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), log_tax.alias("x"))
    kept = F.when(finite("x"), F.col("x"))
    return line.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(kept).alias("n_finite"),
        F.round(F.avg(kept), 6).alias("mean_log_tax"))
