"""Agreement of two readings of a series, and ordered operators along a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, windows
from ..operators.ordered import beside
from .fixtures import DAILY_SQL, READ_SQL, daily, reading, rounded
from .registry import query, table


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = daily(spark, sf_dir)
    return metrics.sample_pairs(series, reading(series), ["record"])


@query("signal_snr", f"""WITH {READ_SQL},
g AS (SELECT record, count(ref) AS n_ref, count(*) FILTER (WHERE ref IS NOT NULL AND est IS NOT NULL) AS n_both,
             avg(ref * ref) FILTER (WHERE est IS NOT NULL) AS ps,
             avg((ref - est) * (ref - est)) AS pn FROM pairs GROUP BY record)
SELECT record, n_ref, n_both, round(ps, 8) AS p_signal, round(pn, 8) AS p_noise,
       round(CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE) WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END
             * n_both / n_ref, 6) AS snr FROM g""")
def signal_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.signal_snr(_pairs(spark, sf_dir), ["record"]), 8, "p_signal", "p_noise").withColumn(
        "snr", F.round("snr", 6))


@query("signal_snr_filled", f"""WITH {READ_SQL},
g AS (SELECT record, median(ref * ref) AS ps, avg((ref - coalesce(est, 0)) * (ref - coalesce(est, 0))) AS pn
      FROM pairs WHERE ref IS NOT NULL GROUP BY record)
SELECT record, round(CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE)
                          WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END, 6) AS snr FROM g""")
def signal_snr_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.signal_snr(_pairs(spark, sf_dir), ["record"], keep_gaps=False, median_signal=True)
    return out.select("record", F.round("snr", 6).alias("snr"))


@query("signal_pearson", f"""WITH {READ_SQL},
b AS (SELECT * FROM pairs WHERE ref IS NOT NULL AND est IS NOT NULL)
SELECT record, count(*) AS n_both,
       round(CASE WHEN count(*) >= 2 AND min(ref) < max(ref) AND min(est) < max(est)
             THEN corr(ref, est) END, 6) AS pearson_r FROM b GROUP BY record""")
def signal_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.pearson(_pairs(spark, sf_dir), ["record"]), 6, "pearson_r")


@query("pearson_per_supplier", """
SELECT l_suppkey AS supplier, count(*) AS n_both,
       round(CASE WHEN count(*) >= 2 AND min(l_quantity) < max(l_quantity)
                   AND min(l_extendedprice) < max(l_extendedprice)
             THEN corr(l_quantity, l_extendedprice) END, 6) AS pearson_r
FROM lineitem GROUP BY l_suppkey""")
def pearson_per_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), F.col("l_quantity").alias("ref"), F.col("l_extendedprice").alias("est"))
    return rounded(metrics.pearson(pairs, ["supplier"]), 6, "pearson_r")


@query("valid_window", f"""WITH {READ_SQL}
SELECT record, min(t) AS window_start, max(t) + 1 AS window_end FROM reading WHERE NOT isnan(mv) GROUP BY record""")
def valid_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.valid_window(reading(daily(spark, sf_dir)), ["record"])


@query("cumulative_distance", f"""WITH {READ_SQL},
b AS (SELECT record, t, abs(ref) AS a, abs(est) AS b FROM pairs WHERE ref IS NOT NULL AND est IS NOT NULL),
c AS (SELECT record, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS ta, sum(b) OVER p AS tb FROM b
      WINDOW w AS (PARTITION BY record ORDER BY t ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY record))
SELECT record, round(1 - max(abs(CASE WHEN ta > 0 THEN ca / ta ELSE ca END
                               - CASE WHEN tb > 0 THEN cb / tb ELSE cb END)), 6) AS ks FROM c GROUP BY record""")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.cumulative_distance(_pairs(spark, sf_dir), ["record"], grid=8), 6, "ks")


@query("signed_correlation_index", f"""WITH {READ_SQL},
b AS (SELECT * FROM pairs WHERE ref IS NOT NULL AND est IS NOT NULL),
s AS (SELECT record, 0.05 * stddev_pop(ref) AS lim FROM b GROUP BY record)
SELECT record, round(avg(CASE WHEN abs(ref - est) <= lim THEN 1.0 ELSE -1.0 END), 6) AS asci
FROM b JOIN s USING (record) GROUP BY record""")
def signed_correlation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.signed_correlation_index(_pairs(spark, sf_dir), ["record"]), 6, "asci")


ALIGN_SQL = """
sh AS (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS shift),
ln AS (SELECT record, max(t) + 1 AS n FROM {pairs} GROUP BY record),
ov AS (SELECT r.record, sh.shift, r.ref AS ref, e.est AS est
       FROM {pairs} r JOIN ln USING (record) CROSS JOIN sh
       LEFT JOIN {pairs} e ON e.record = r.record AND e.t = r.t + sh.shift
       WHERE r.ref IS NOT NULL AND abs(sh.shift) <= n - 1 AND r.t + sh.shift >= 0 AND r.t + sh.shift < n),
of AS (SELECT record, shift, median(est - ref) AS offs FROM ov GROUP BY record, shift),
sc AS (SELECT record, shift, any_value(offs) AS offs, count(ref) AS n_ref, count(est) AS n_both,
              avg(ref * ref) FILTER (WHERE est IS NOT NULL) AS ps,
              avg((est - ref - offs) * (est - ref - offs)) AS pn
       FROM ov JOIN of USING (record, shift) GROUP BY record, shift),
sn AS (SELECT record, shift, offs, CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE)
              WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END * n_both / n_ref AS snr FROM sc WHERE n_both >= 2),
be AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY snr DESC, shift) AS rn FROM sn WHERE snr IS NOT NULL)"""


@query("aligned_snr", f"""WITH {READ_SQL}, {ALIGN_SQL.format(pairs='pairs')}
SELECT p.record, round(be.snr, 6) AS snr_aligned, coalesce(be.shift, 0) AS shift, round(be.offs, 6) AS "offset"
FROM (SELECT DISTINCT record FROM pairs) p LEFT JOIN be ON be.record = p.record AND be.rn = 1""")
def aligned_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.aligned_snr(_pairs(spark, sf_dir), ["record"], max_shift=3), 6, "snr_aligned", "offset")


@query("evaluate_signals", f"""WITH {DAILY_SQL},
gt AS (SELECT record, 'I' AS lead, t, CASE WHEN t < 4 + record % 5 OR t > 25 THEN NULL ELSE mv END AS mv FROM daily),
pr AS (SELECT record, 'I' AS lead, CASE WHEN record % 3 = 0 THEN t - 4 - record % 5 ELSE t END AS t,
              floor(mv / 10) * 10 AS mv FROM daily
       WHERE record % 10 <> 9 AND (record % 3 <> 0 OR t >= 4 + record % 5)),
win AS (SELECT record, lead, min(t) AS i0, max(t) + 1 AS i1 FROM gt WHERE mv IS NOT NULL GROUP BY 1, 2),
seg AS (SELECT g.record, g.lead, g.t - i0 AS t, g.mv AS ref FROM gt g JOIN win USING (record, lead)
        WHERE g.t >= i0 AND g.t < i1),
est AS (SELECT p.record, p.lead, p.t AS t, p.mv AS est, 'start' AS placement FROM pr p JOIN win USING (record, lead)
        WHERE p.t < i1 - i0
        UNION ALL
        SELECT p.record, p.lead, p.t - i0, p.mv, 'window' FROM pr p JOIN win USING (record, lead)
        WHERE p.t >= i0 AND p.t < i1),
ref AS (SELECT seg.*, m.placement FROM seg CROSS JOIN (VALUES ('start'), ('window')) m(placement)),
pp AS (SELECT coalesce(r.record, e.record) AS record, coalesce(r.lead, e.lead) AS lead,
              coalesce(r.placement, e.placement) AS placement, coalesce(r.t, e.t) AS t, r.ref, e.est
       FROM ref r FULL JOIN est e ON r.record = e.record AND r.lead = e.lead AND r.placement = e.placement AND r.t = e.t),
g AS (SELECT record, lead, placement, count(ref) AS n_ref,
             count(*) FILTER (WHERE ref IS NOT NULL AND est IS NOT NULL) AS n_both,
             avg(ref * ref) FILTER (WHERE est IS NOT NULL) AS ps,
             avg((ref - est) * (ref - est)) AS pn FROM pp GROUP BY 1, 2, 3),
s AS (SELECT record, lead, placement, CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE)
             WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END * n_both / n_ref AS snr FROM g),
c AS (SELECT *, row_number() OVER (PARTITION BY record, lead
             ORDER BY coalesce(snr, CAST('-inf' AS DOUBLE)) DESC, placement) AS rn FROM s),
kept AS (SELECT pp.record, pp.t, pp.ref, pp.est FROM pp JOIN c USING (record, lead, placement) WHERE c.rn = 1),
pe AS (SELECT record, CASE WHEN count(*) >= 2 AND min(ref) < max(ref) AND min(est) < max(est)
                      THEN corr(ref, est) END AS r FROM kept WHERE ref IS NOT NULL AND est IS NOT NULL GROUP BY record),
{ALIGN_SQL.format(pairs='kept')},
ids AS (SELECT DISTINCT record, lead FROM gt),
has AS (SELECT DISTINCT record, lead, 1 AS one FROM pr),
al AS (SELECT ids.record, ids.lead, i0, i1, (one IS NULL OR i0 IS NULL) AS missing FROM ids
       LEFT JOIN win USING (record, lead) LEFT JOIN has USING (record, lead))
SELECT al.record, al.lead, CASE WHEN missing THEN '' ELSE c.placement END AS placement,
       coalesce(i1 - i0, 0) AS n_samples, coalesce(i0, -1) AS window_start, coalesce(i1, -1) AS window_end,
       CASE WHEN NOT missing THEN round(c.snr, 6) END AS snr_raw,
       CASE WHEN NOT missing THEN round(pe.r, 6) END AS pearson_r,
       CASE WHEN NOT missing THEN round(be.snr, 6) END AS snr_aligned,
       CASE WHEN NOT missing THEN coalesce(be.shift, 0) END AS shift,
       CASE WHEN NOT missing THEN round(be.offs, 6) END AS "offset", missing
FROM al LEFT JOIN c ON c.record = al.record AND c.lead = al.lead AND c.rn = 1
LEFT JOIN pe ON pe.record = al.record LEFT JOIN be ON be.record = al.record AND be.rn = 1""")
def evaluate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = daily(spark, sf_dir).withColumn("lead", F.lit("I"))
    shift = 4 + F.col("record") % 5
    gt = series.withColumn("mv", F.when((F.col("t") < shift) | (F.col("t") > 25), F.lit(float("nan"))).otherwise(F.col("mv")))
    early = F.col("record") % 3 == 0
    pred = (series.filter((F.col("record") % 10 != 9) & (~early | (F.col("t") >= shift)))
            .withColumn("t", F.when(early, F.col("t") - shift).otherwise(F.col("t")))
            .withColumn("mv", F.floor(F.col("mv") / 10) * 10.0))
    out = metrics.evaluate_signals(gt, pred, max_shift=3)
    return rounded(out, 6, "snr_raw", "pearson_r", "snr_aligned", "offset")


@query("column_runs", f"""WITH {DAILY_SQL},
n AS (SELECT record, t, t - row_number() OVER (PARTITION BY record ORDER BY t) AS island FROM daily)
SELECT record, min(t) AS run_start, max(t) + 1 AS run_end, count(*) AS run_length FROM n GROUP BY record, island""")
def column_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.column_runs(daily(spark, sf_dir), ["record"], "t")


@query("max_gap_clipped", f"""WITH {DAILY_SQL},
n AS (SELECT record, t, lead(t) OVER (PARTITION BY record ORDER BY t) AS nx FROM daily)
SELECT record, greatest(coalesce(max(least(nx, 24) - greatest(t + 1, 5)) FILTER (WHERE nx IS NOT NULL), 0), 0) AS max_gap
FROM n GROUP BY record""")
def max_gap_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.max_gap(daily(spark, sf_dir), ["record"], "t", (F.lit(5), F.lit(24)))


@query("max_gap", f"""WITH {DAILY_SQL},
n AS (SELECT record, t, lead(t) OVER (PARTITION BY record ORDER BY t) AS nx FROM daily)
SELECT record, greatest(coalesce(max(nx - t - 1), 0), 0) AS max_gap FROM n GROUP BY record""")
def max_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.max_gap(daily(spark, sf_dir), ["record"], "t")


@query("overhang", f"""WITH {DAILY_SQL}
SELECT record, greatest(3 - (min(t) + 0.5), max(t) + 0.5 - 26, 0.0)::DOUBLE AS overhang FROM daily GROUP BY record""")
def overhang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.overhang(daily(spark, sf_dir), ["record"], "t", (F.lit(3.0), F.lit(26.0)))


@query("unwrap_phase", f"""WITH {DAILY_SQL},
h AS (SELECT record, t, ((CAST(mv AS BIGINT) % 24) + 24) % 24 AS hour FROM
      (SELECT record, t, trunc(mv) AS mv FROM daily)),
s AS (SELECT *, hour - lag(hour) OVER (PARTITION BY record ORDER BY t) AS d FROM h),
w AS (SELECT *, CASE WHEN d IS NULL THEN hour ELSE ((((d + 12) % 24) + 24) % 24) - 12 END AS st FROM s)
SELECT record, t, hour, sum(st) OVER (PARTITION BY record ORDER BY t ROWS UNBOUNDED PRECEDING)::DOUBLE AS unwrapped
FROM w""")
def unwrap_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = daily(spark, sf_dir).select("record", "t", F.pmod(F.col("mv").cast("bigint"), F.lit(24)).alias("hour"))
    return windows.unwrap(hours, ["record"], "t", "hour", 24.0, grid=8)


@query("aperture_filter", f"""WITH {DAILY_SQL},
n AS (SELECT *, t - row_number() OVER (PARTITION BY record ORDER BY t) AS island FROM daily)
SELECT record, t, mv, round(mv - 0.125 * (coalesce(lag(mv) OVER w, mv) - 2 * mv + coalesce(lead(mv) OVER w, mv)), 6)
       AS filtered FROM n WINDOW w AS (PARTITION BY record, island ORDER BY t)""")
def aperture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.aperture_filter(daily(spark, sf_dir), ["record"], "t", "mv"), 6, "filtered")


@query("neighbour_spikes", f"""WITH {DAILY_SQL},
n AS (SELECT *, lag(mv) OVER w AS l1, lag(mv, 2) OVER w AS l2, lead(mv) OVER w AS r1, lead(mv, 2) OVER w AS r2,
             count(*) OVER (PARTITION BY record) AS n FROM daily WINDOW w AS (PARTITION BY record ORDER BY t)),
m AS (SELECT record, t, mv, n, list_median([coalesce(l1, mv), coalesce(r1, mv), coalesce(l2, l1, mv),
             coalesce(r2, r1, mv)]) AS nm FROM n)
SELECT record, t, mv, round(nm, 6) AS neighbour_median, n >= 5 AND abs(mv - nm) > 40.003 AS spike FROM m""")
def neighbour_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.neighbour_spikes(daily(spark, sf_dir), ["record"], "t", "mv", 40.003)
    return rounded(out, 6, "neighbour_median")


@query("jump_runs", f"""WITH {DAILY_SQL},
n AS (SELECT *, CASE WHEN abs(mv - lag(mv) OVER (PARTITION BY record ORDER BY t)) > 60.003 THEN 1 ELSE 0 END AS cut
      FROM daily),
r AS (SELECT record, t, mv, sum(cut) OVER (PARTITION BY record ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n),
l AS (SELECT *, count(*) OVER (PARTITION BY record, run) AS run_length FROM r)
SELECT * FROM l WHERE run_length >= 4""")
def jump_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.jump_runs(daily(spark, sf_dir), ["record"], "t", "mv", 60.003, 4, grid=8)


@query("running_median", f"""WITH {DAILY_SQL},
n AS (SELECT *, t - lag(t) OVER (PARTITION BY record ORDER BY t) AS d FROM daily),
e AS (SELECT record, min(t) AS m0, max(t) AS m1, min_by(mv, t) AS v0, max_by(mv, t) AS v1,
             coalesce(median(d), 2.5)::DOUBLE AS gap FROM n GROUP BY record),
k AS (SELECT *, unnest(range(1, CAST(ceil(2.5 / gap) AS BIGINT) + 2)) AS k FROM e),
x AS (SELECT record, t::DOUBLE AS t, mv, false AS pad FROM daily
      UNION ALL SELECT record, m0 - gap * k, v0, true FROM k UNION ALL SELECT record, m1 + gap * k, v1, true FROM k),
w AS (SELECT record, t, mv, pad, median(mv) OVER (PARTITION BY record ORDER BY t
             RANGE BETWEEN 2.5 PRECEDING AND 2.5 FOLLOWING) AS sm FROM x)
SELECT record, t, mv, round(sm, 6) AS smoothed FROM w WHERE NOT pad""")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.running_median(daily(spark, sf_dir), ["record"], "t", "mv", 5.0), 6, "smoothed")


@query("sliding_window_max", f"""WITH {DAILY_SQL},
s AS (SELECT CAST(unnest(range(0, n - 9, 5)) AS BIGINT) AS window_start FROM (SELECT max(t) + 1 AS n FROM daily))
SELECT record, window_start, max(mv) AS window_max, count(mv) AS n
FROM daily JOIN s ON t >= window_start AND t < window_start + 10 GROUP BY ALL""")
def sliding_window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = daily(spark, sf_dir)
    whole = beside(series, series.agg((F.max("t") + 1).alias("total")))
    return windows.sliding_max(whole, ["record"], "t", "mv", 10, 5, F.col("total"))


@query("zone_statistics", f"""WITH {READ_SQL},
z AS (SELECT record % 7 AS part, CASE WHEN t < 4 THEN 'head' WHEN t >= 26 THEN 'tail' ELSE 'interior' END AS zone,
             abs(ref - est) AS d FROM pairs WHERE ref IS NOT NULL AND est IS NOT NULL)
SELECT part, zone, round(max(d), 6) AS d_max, count(d) AS n, round(median(d), 6) AS d_median,
       round(quantile_cont(d, 0.99), 6) AS d_p99 FROM z GROUP BY part, zone""")
def zone_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).filter("ref IS NOT NULL AND est IS NOT NULL").select(
        (F.col("record") % 7).alias("part"), "t", (F.col("ref") - F.col("est")).alias("diff"))
    out = windows.zone_statistics(pairs, ["part"], "t", "diff", F.lit(30), 4)
    return rounded(out, 6, "d_max", "d_median", "d_p99")


@query("window_gaps", f"""WITH {READ_SQL},
w AS (SELECT record, est, t >= record % 4 * 7 AND t < record % 4 * 7 + 7 AS inside FROM pairs)
SELECT record, count(*) FILTER (WHERE inside) AS n_window, count(*) FILTER (WHERE inside AND est IS NULL) AS n_nan,
       round(CASE WHEN count(*) FILTER (WHERE inside) > 0 THEN count(*) FILTER (WHERE inside AND est IS NULL)
             / count(*) FILTER (WHERE inside) END, 6) AS nan_frac,
       count(*) FILTER (WHERE inside) > 0 AND count(*) FILTER (WHERE inside AND est IS NOT NULL) = 0 AS missing
FROM w GROUP BY record""")
def window_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("record") % 4 * 7
    inside = (F.col("t") >= start) & (F.col("t") < start + 7)
    return rounded(windows.window_gaps(_pairs(spark, sf_dir), ["record"], "est", inside), 6, "nan_frac")


@query("snr_check", f"""WITH {READ_SQL},
g AS (SELECT record, count(ref) AS n_ref, count(*) FILTER (WHERE ref IS NOT NULL AND est IS NOT NULL) AS n_both,
             avg(ref * ref) FILTER (WHERE est IS NOT NULL) AS ps,
             avg((ref - est) * (ref - est)) AS pn FROM pairs GROUP BY record),
o AS (SELECT record, CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE) WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END
             * n_both / n_ref AS ours FROM g),
t AS (SELECT record, CASE WHEN record % 9 = 4 THEN NULL ELSE round(ours, 3) END AS theirs FROM o WHERE record % 5 <> 2)
SELECT round(max(abs(ours - theirs)) FILTER (WHERE NOT isinf(ours)), 6) AS snr_check_max_absdiff,
       count(*) FILTER (WHERE theirs IS NOT NULL AND NOT isinf(ours)) AS snr_check_n_leads,
       count(*) FILTER (WHERE (theirs IS NOT NULL AND NOT isinf(theirs)) <> (ours IS NOT NULL AND NOT isinf(ours)))
       AS snr_check_n_mismatch
FROM o JOIN t USING (record)""")
def snr_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ours = metrics.signal_snr(_pairs(spark, sf_dir), ["record"]).select("record", F.lit("aVR").alias("lead"), "snr")
    theirs = ours.select(
        "record", F.lit("AVR").alias("lead"),
        F.when(F.col("record") % 9 == 4, F.lit("")).otherwise(F.round("snr", 3).cast("string")).alias("snr_raw"),
        F.when(F.col("record") % 5 == 2, "True").otherwise("False").alias("missing"))
    return rounded(metrics.snr_check(ours, theirs), 6, "snr_check_max_absdiff")
