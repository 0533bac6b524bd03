"""Readings as the classifier sees them, and the table of conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fidelity, metrics
from .decision_queries import CLASSES, KAPPA_SQL, THRESHOLDS
from .fixtures import READ_SQL, daily, reading, rounded
from .registry import query, table
from .trace_queries import TAPS_5, _days, _full


@query("prepared_snr", f"""WITH {READ_SQL}, taps(j, h) AS (VALUES {TAPS_5}),
days AS (SELECT (max(t) + 1)::BIGINT AS n FROM daily), ids AS (SELECT DISTINCT record FROM daily),
src AS (SELECT record, 0 AS kind, t, mv FROM daily UNION ALL SELECT record, 1, t, mv FROM reading WHERE NOT isnan(mv)),
g AS (SELECT record, kind, CAST(unnest(range(0, n)) AS INTEGER) AS t FROM ids CROSS JOIN (VALUES (0), (1)) k(kind) CROSS JOIN days),
fx AS (SELECT g.*, mv FROM g LEFT JOIN src USING (record, kind, t)),
nb AS (SELECT *, last_value(mv IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN mv IS NOT NULL THEN t END IGNORE NULLS) OVER b AS pt,
              first_value(mv IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN mv IS NOT NULL THEN t END IGNORE NULLS) OVER a AS nt FROM fx
       WINDOW b AS (PARTITION BY record, kind ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY record, kind ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fill AS (SELECT record, kind, t, coalesce(CASE WHEN mv IS NOT NULL THEN mv WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
                ELSE pv + (t - pt) * ((nv - pv) / (nt - pt)) END, 0.0)::DOUBLE AS x, (pt IS NOT NULL AND nt IS NOT NULL) AS in_span FROM nb),
en AS (SELECT record, kind, min_by(x, t) AS x0, max_by(x, t) AS x1 FROM fill GROUP BY 1, 2),
m AS (SELECT unnest(range(-60, n + 60)) AS m, n - 1 AS last FROM days),
ex AS (SELECT en.record, en.kind, m, CASE WHEN m < 0 THEN x0 + m * (x1 - x0) / last WHEN m > last THEN x1 + (m - last) * (x1 - x0) / last ELSE x END AS x
       FROM en CROSS JOIN m LEFT JOIN fill f ON f.record = en.record AND f.kind = en.kind AND f.t = m),
k AS (SELECT unnest(range(0, (n + 4) // 5)) AS t FROM days),
y AS (SELECT record, kind, k.t, sum(x * h) AS y FROM ex CROSS JOIN k JOIN taps ON j = 50 + k.t * 5 - m WHERE k.t < 1000 GROUP BY 1, 2, 3),
p AS (SELECT y.record, y.kind, y.t, CAST(CASE WHEN in_span THEN y ELSE 0.0 END AS FLOAT)::DOUBLE AS y, in_span FROM y JOIN fill f ON f.record = y.record AND f.kind = y.kind AND f.t = y.t * 5),
s AS (SELECT a.record, count(*) AS n_window, avg(a.y * a.y) AS ps, avg((a.y - b.y) * (a.y - b.y)) AS pn FROM p a JOIN p b ON a.record = b.record AND a.t = b.t AND a.kind = 0 AND b.kind = 1 WHERE a.in_span GROUP BY 1)
SELECT record, n_window, round(CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE) WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END, 3) AS snr FROM s""")
def prepared_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNR of every user's reading after both series went to a fifth of their rate."""
    series = daily(spark, sf_dir)
    grid = series.select("record").distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(_days(spark, sf_dir) - 1))))
    out = fidelity.prepared_snr(grid.join(series, ["record", "t"], "left"), _full(spark, sf_dir), ["record"], 500, 100, 1000)
    return out.select("record", "n_window", F.round("snr", 3).alias("snr"))


# Conditions differ in the weight of what a reading adds to the scores; a user counts as missing where too few days were read.
CONDITIONS = (("clean", 0.125, 2), ("rotated", 0.5, 10), ("blurred", 1.0, 18))
_PER_CLASS = ", ".join(f"max(CASE WHEN class = '{c}' THEN round({v}, 6) END) AS {n}_{c}" for n, v in (("kappa", "k"),) for c in CLASSES)
_RANKED = ", ".join(f"max(CASE WHEN class = '{c}' THEN {v} END) AS {n}_{c}" for n, v in (("ret", "round(t / nullif(r, 0), 6)"), ("npos", "n_pos")) for c in CLASSES)


def _kappa(pa: str, pb: str, po: str) -> str:
    pe = f"({pa} * {pb} + (1 - {pa}) * (1 - {pb}))"
    return KAPPA_SQL.replace("pe", pe).replace("po", po)


@query("condition_table", f"""WITH {READ_SQL},
dim(o, class, thr) AS (VALUES {', '.join(f"({i}, '{c}', {t}::DOUBLE)" for i, (c, t) in enumerate(zip(CLASSES, THRESHOLDS)))}),
cond(condition, w, least_days) AS (VALUES {', '.join(f"('{c}', {w}::DOUBLE, {n})" for c, w, n in CONDITIONS)}),
lg AS (SELECT condition, vec_id AS record, class, thr, thr + 0.05::DOUBLE AS thr_full, embedding[o + 1]::DOUBLE AS r, embedding[o + 1]::DOUBLE + w * embedding[o + 6]::DOUBLE AS t,
              CASE WHEN label IS NULL THEN NULL WHEN label % 5 = o OR label % 3 = o THEN 1 ELSE 0 END AS y FROM embeddings CROSS JOIN dim CROSS JOIN cond),
d AS (SELECT *, (r > thr)::INT AS a, (t > thr)::INT AS b, (r > thr_full)::INT AS fa, (t > thr_full)::INT AS fb, abs(1 / (1 + exp(-r)) - 1 / (1 + exp(-t))) AS dp FROM lg),
c AS (SELECT condition, class, {_kappa('avg(a)', 'avg(b)', 'avg((a = b)::INT)')} AS k FROM d GROUP BY 1, 2),
kc AS (SELECT condition, {_PER_CLASS} FROM c GROUP BY 1),
s AS (SELECT condition, round({_kappa('avg(a)', 'avg(b)', 'avg((a = b)::INT)')}, 6) AS kappa, count(*) FILTER (WHERE a <> b) AS n_flips, round(avg((a <> b)::INT), 6) AS flip_rate,
             round(avg(dp), 6) AS mean_abs_dp, round(max(dp), 6) AS max_abs_dp, round({_kappa('avg(fa)', 'avg(fb)', 'avg((fa = fb)::INT)')}, 6) AS kappa_thrfull,
             round(avg((fa <> fb)::INT), 6) AS flip_rate_thrfull FROM d GROUP BY 1),
rc AS (SELECT condition, record, bool_or(a <> b) AS f, bool_or(fa <> fb) AS ff FROM d GROUP BY 1, 2),
rs AS (SELECT condition, count(*) AS n_records, count(*) FILTER (WHERE f) AS n_record_flips, round(avg(f::INT), 6) AS record_flip_rate, round(avg(ff::INT), 6) AS record_flip_rate_thrfull FROM rc GROUP BY 1),
lo AS (SELECT condition, class, sy, z, sum(y) AS pos, sum(1 - y) AS neg FROM (SELECT condition, class, y, unnest(['r', 't']) AS sy, unnest([r, t]) AS z FROM lg WHERE y IS NOT NULL) GROUP BY 1, 2, 3, 4),
lc AS (SELECT *, sum(neg) OVER (PARTITION BY condition, class, sy ORDER BY z) AS cum FROM lo),
au AS (SELECT condition, class, sy, sum(pos * (cum - neg + neg / 2.0)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auc, sum(pos)::BIGINT AS n_pos FROM lc GROUP BY 1, 2, 3),
aw AS (SELECT condition, class, max(auc) FILTER (WHERE sy = 'r') AS r, max(auc) FILTER (WHERE sy = 't') AS t, max(n_pos) AS n_pos FROM au GROUP BY 1, 2),
am AS (SELECT condition, round(avg(r) FILTER (WHERE r IS NOT NULL AND t IS NOT NULL), 6) AS auroc_ref_macro, round(avg(t) FILTER (WHERE r IS NOT NULL AND t IS NOT NULL), 6) AS auroc_test_macro,
              round(avg(t) FILTER (WHERE r IS NOT NULL AND t IS NOT NULL) / avg(r) FILTER (WHERE r IS NOT NULL AND t IS NOT NULL), 6) AS auroc_retention_macro, {_RANKED} FROM aw GROUP BY 1),
wl AS (SELECT record, count(*) AS n_window, count(*) FILTER (WHERE est IS NULL) AS n_nan FROM pairs WHERE ref IS NOT NULL GROUP BY 1),
lm AS (SELECT condition, n_window, n_nan, n_window - n_nan < least_days AS missing FROM wl CROSS JOIN cond),
ls AS (SELECT condition, round(sum(n_nan) FILTER (WHERE NOT missing) / nullif(sum(n_window) FILTER (WHERE NOT missing), 0), 6) AS interior_nan_frac, count(*) FILTER (WHERE missing) AS missing_leads FROM lm GROUP BY 1),
g AS (SELECT record, count(ref) AS n_ref, count(*) FILTER (WHERE ref IS NOT NULL AND est IS NOT NULL) AS n_both, avg(ref * ref) FILTER (WHERE est IS NOT NULL) AS ps, avg((ref - est) * (ref - est)) AS pn FROM pairs GROUP BY 1),
sn AS (SELECT n_both, CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE) WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END * n_both / n_ref AS snr FROM g),
sm AS (SELECT condition, round(median(snr), 6) AS snr_median_db FROM sn CROSS JOIN cond WHERE n_both >= least_days AND isfinite(snr) GROUP BY 1)
SELECT * FROM s JOIN kc USING (condition) JOIN rs USING (condition) LEFT JOIN am USING (condition) LEFT JOIN ls USING (condition) LEFT JOIN sm USING (condition)""")
def condition_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conditions over all vectors (scores) and all users (lost days and SNR)."""
    cells = F.array(*[F.struct(
        F.lit(name).alias("condition"), F.lit(c).alias("class"), F.lit(float(thr)).alias("thr"), F.lit(thr + 0.05).alias("thr_full"),
        F.col("embedding")[i].cast("double").alias("z_ref"), (F.col("embedding")[i].cast("double") + F.lit(w) * F.col("embedding")[i + 5].cast("double")).alias("z_test"),
        F.when(F.col("label").isNotNull(), ((F.col("label") % 5 == i) | (F.col("label") % 3 == i)).cast("int")).alias("y"))
        for name, w, _ in CONDITIONS for i, (c, thr) in enumerate(zip(CLASSES, THRESHOLDS))])
    logits = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record"), F.inline(cells))

    series = daily(spark, sf_dir)
    read = reading(series)
    limits = F.inline(F.array(*[F.struct(F.lit(name).alias("condition"), F.lit(n).alias("least_days")) for name, _, n in CONDITIONS]))
    losses = fidelity.window_losses(series, read, ["record"]).select("n_window", "n_nan", limits)
    losses = losses.withColumn("missing", F.col("n_window") - F.col("n_nan") < F.col("least_days"))
    scored = metrics.signal_snr(metrics.sample_pairs(series, read, ["record"]), ["record"]).select("n_both", F.col("snr").alias("snr_raw"), limits)
    evaluation = scored.withColumn("missing", F.col("n_both") < F.col("least_days"))
    out = fidelity.condition_table(logits, CLASSES, losses, evaluation)
    return rounded(out, 6, *[f.name for f in out.schema if f.dataType.typeName() == "double"])
