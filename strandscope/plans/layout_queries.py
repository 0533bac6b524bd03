"""Page layout, headers, labels, splits and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import headers
from ..functions.numbers import number_text
from ..operators import grid, labels, metrics
from .fixtures import DAILY_SQL, READ_SQL, daily, day_fraction, day_index, reading, rounded
from .registry import query, table

# One page per customer: boxes of the twelve leads with small errors that depend on the
# customer, and for some customers a lost column, a stray edge or a short rhythm strip.
COLUMNS_SQL = """
leads(lead, c) AS (VALUES ('I', 0), ('II', 0), ('III', 0), ('aVR', 1), ('aVL', 1), ('aVF', 1),
                          ('V1', 2), ('V2', 2), ('V3', 2), ('V4', 3), ('V5', 3), ('V6', 3)),
box AS (SELECT c_custkey AS record, lead, c,
               (100 + 500 * CASE WHEN lead = 'II' THEN 0 ELSE c END + (c_custkey + length(lead)) % 5 - 2
                + CASE WHEN c_custkey % 13 = 4 AND lead = 'V2' THEN 60 ELSE 0 END
                + CASE WHEN c_custkey % 23 = 9 AND c = 2 THEN 14 ELSE 0 END)::DOUBLE AS x1,
               (CASE WHEN lead <> 'II' THEN 500 WHEN c_custkey % 17 = 3 THEN 490
                     WHEN c_custkey % 17 = 5 THEN 1300 ELSE 2000 END + (c_custkey // 7) % 3)::DOUBLE AS width
        FROM customer CROSS JOIN leads WHERE NOT (c_custkey % 11 = 6 AND c = 3) AND c_custkey % 29 <> 8),
hts AS (SELECT c_custkey AS record, (CASE WHEN c_custkey % 2 = 0 THEN 1728.0 ELSE 1700.0 END)::DOUBLE AS height FROM customer)"""


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    leads = F.explode(F.array(*[F.struct(F.lit(n).alias("lead"), F.lit(dims.COLUMN[n]).alias("c")) for n in dims.LEADS]))
    k, lead, c = F.col("c_custkey"), F.col("l.lead"), F.col("l.c")
    pages = table(spark, sf_dir, "customer").select("c_custkey")
    rows = pages.filter("c_custkey % 29 <> 8").withColumn("l", leads).filter(~((k % 11 == 6) & (c == 3)))
    x1 = (100 + 500 * F.when(lead == "II", 0).otherwise(c) + (k + F.length(lead)) % 5 - 2
          + F.when((k % 13 == 4) & (lead == "V2"), 60).otherwise(0) + F.when((k % 23 == 9) & (c == 2), 14).otherwise(0))
    width = (F.when(lead != "II", 500).when(k % 17 == 3, 490).when(k % 17 == 5, 1300).otherwise(2000) + F.floor(k / 7) % 3)
    boxes = rows.select(k.alias("record"), lead.alias("lead"), x1.cast("double").alias("x1"), width.cast("double").alias("width"))
    heights = pages.select(k.alias("record"), F.when(k % 2 == 0, 1728.0).otherwise(1700.0).alias("height"))
    return boxes, heights


def _grid_sql(tolerance: float, prefix: str) -> str:
    p = prefix
    return f"""
{p}med AS (SELECT record, median(width) AS med FROM box GROUP BY record),
{p}lw AS (SELECT box.*, med, width >= 2 * med AS is_long FROM box JOIN {p}med USING (record)),
{p}e AS (SELECT record, lead, (CASE WHEN is_long THEN 0 ELSE c END)::DOUBLE AS b, x1 AS x, true AS s FROM {p}lw UNION ALL
         SELECT record, lead, (CASE WHEN is_long THEN 4 ELSE c + 1 END)::DOUBLE, x1 + width, false FROM {p}lw),
{p}p AS (SELECT a.record, median((z.x - a.x) / (z.b - a.b)) AS p FROM {p}e a JOIN {p}e z ON a.record = z.record AND a.b < z.b GROUP BY 1),
{p}m AS (SELECT record, p, median(x - b * p) AS mid FROM {p}e JOIN {p}p USING (record) GROUP BY 1, 2),
{p}i AS (SELECT {p}e.* FROM {p}e JOIN {p}m USING (record) WHERE abs(x - b * p - mid) <= {tolerance} * p),
{p}x AS (SELECT record, b, min(x) AS x FROM {p}i WHERE s GROUP BY 1, 2 UNION ALL
         SELECT record, b, max(x) FROM {p}i WHERE NOT s GROUP BY 1, 2),
{p}f AS (SELECT record, regr_slope(x, b) AS pf, count(*) AS n, height * 62.5 / 215.9 AS pp FROM {p}x JOIN hts USING (record) GROUP BY record, height),
{p}q AS (SELECT record, n, CASE WHEN abs(pf - pp) <= 0.0015 * pp THEN pp ELSE pf END AS pitch FROM {p}f),
{p}g AS (SELECT record, n, pitch, avg(x - b * pitch) AS g0 FROM {p}q JOIN {p}x USING (record) GROUP BY 1, 2, 3),
{p}r AS (SELECT record, n, pitch, g0, max(abs(x - (g0 + b * pitch))) AS residual FROM {p}g JOIN {p}x USING (record) GROUP BY 1, 2, 3, 4),
{p}w AS (SELECT record, count(*) FILTER (WHERE is_long) AS n_long, bool_or(is_long AND width < 3.5 * med) AS partial,
               count(DISTINCT c) FILTER (WHERE NOT is_long) AS n_cols,
               string_agg(lead, ',' ORDER BY lead) FILTER (WHERE is_long) AS long_leads FROM {p}lw GROUP BY record),
{p}out AS (SELECT hts.record, g0, pitch, residual, coalesce(long_leads, '') AS long_leads,
               CASE WHEN {p}w.record IS NULL THEN 'no_boxes' WHEN n_long = 0 THEN 'no_strip'
                    WHEN partial THEN 'short_strip'
                    WHEN n_cols < 4 THEN 'bare_column'
                    WHEN coalesce(n, 0) < 8 THEN 'edges_lost'
                    WHEN residual > {tolerance} * pitch THEN 'edges_off' END AS reason
        FROM hts LEFT JOIN {p}w USING (record) LEFT JOIN {p}r USING (record))"""


@query("fit_column_grid", f"""WITH {COLUMNS_SQL}, {_grid_sql(0.02, 'a')}
SELECT record, CASE WHEN reason IS NULL THEN round(g0, 6) END AS g0, CASE WHEN reason IS NULL THEN round(pitch, 6) END AS pitch,
       CASE WHEN reason IS NULL OR reason = 'edges_off' THEN round(residual, 6) END AS residual,
       long_leads, reason FROM aout""")
def fit_column_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.fit_column_grid(*_boxes(spark, sf_dir))
    return rounded(out, 6, "g0", "pitch", "residual").withColumn("long_leads", F.array_join("long_leads", ","))


@query("rescued_grid", f"""WITH {COLUMNS_SQL}, {_grid_sql(0.02, 'a')}, {_grid_sql(0.04, 'b')},
j AS (SELECT a.record, a.g0, a.pitch, a.residual, a.reason, b.g0 AS g2, b.pitch AS p2, b.residual AS r2, a.long_leads,
             coalesce(a.reason IN ('edges_off', 'edges_lost') AND b.reason IS NULL, false) AS rescued
      FROM aout a JOIN bout b USING (record))
SELECT record, round(CASE WHEN rescued THEN g2 WHEN reason IS NULL THEN g0 END, 6) AS g0,
       round(CASE WHEN rescued THEN p2 WHEN reason IS NULL THEN pitch END, 6) AS pitch,
       round(CASE WHEN rescued THEN r2 WHEN reason IS NULL OR reason = 'edges_off' THEN residual END, 6) AS residual,
       long_leads, CASE WHEN NOT rescued THEN reason END AS reason, rescued FROM j""")
def rescued_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.rescued_grid(*_boxes(spark, sf_dir))
    return rounded(out, 6, "g0", "pitch", "residual").withColumn("long_leads", F.array_join("long_leads", ","))


OFFSET_SQL = f"""{COLUMNS_SQL},
pos AS (SELECT record, lead, c, x1 + record % 9 * 40 * (CASE WHEN lead = 'II' THEN 0 ELSE 1 END) AS x1,
               CASE WHEN width >= 1900 THEN 5000 ELSE 1250 END AS n FROM box),
rf AS (SELECT record, min(x1) AS ref FROM pos WHERE n >= 5000 GROUP BY record),
rw AS (SELECT pos.*, CASE WHEN n >= 5000 THEN 0.0::DOUBLE ELSE (x1 - ref) * 0.005::DOUBLE END AS raw FROM pos LEFT JOIN rf USING (record)),
sn AS (SELECT *, round_even(raw / 2.5, 0) * 2.5 AS sn FROM rw)"""


@query("lead_offsets", f"""WITH {OFFSET_SQL}
SELECT record, lead, round(raw, 9) AS raw,
       (CASE WHEN n >= 5000 THEN 0.0 WHEN raw IS NULL THEN c * 2.5 ELSE least(greatest(sn, 0.0), 7.5) END)::DOUBLE AS snapped,
       coalesce(n < 5000 AND (abs(raw - sn) > 0.5 OR least(greatest(sn, 0.0), 7.5) <> sn), false) AS suspicious FROM sn""")
def lead_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, _ = _boxes(spark, sf_dir)
    drift = F.when(F.col("lead") == "II", 0).otherwise(F.col("record") % 9 * 40)
    positions = boxes.select("record", "lead", (F.col("x1") + drift).alias("x1"),
                             F.when(F.col("width") >= 1900, 5000).otherwise(1250).alias("n_samples"))
    out = grid.lead_offsets(positions, F.lit(0.005))
    return rounded(out.select("record", "lead", "raw", "snapped", "suspicious"), 9, "raw")


@query("snap_event_hours", """
WITH h AS (SELECT event_id, extract(hour FROM ts) + extract(minute FROM ts) / 60.0::DOUBLE AS raw FROM events)
SELECT event_id, round(raw, 6) AS raw, least(greatest(round_even(raw / 2.5, 0) * 2.5, 0.0), 7.5)::DOUBLE AS snapped FROM h""")
def snap_event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.hour("ts") + F.minute("ts") / 60.0
    ev = table(spark, sf_dir, "events").select("event_id", F.lit("V1").alias("lead"), raw.alias("x1"),
                                               F.lit(1250).alias("n_samples"), F.col("event_id").alias("record"))
    ref = ev.select("event_id", F.lit("II").alias("lead"), F.lit(0.0).alias("x1"), F.lit(5000).alias("n_samples"), "record")
    out = grid.lead_offsets(ev.unionByName(ref), F.lit(1.0)).filter("lead = 'V1'")
    return rounded(out.select("event_id", "raw", "snapped"), 6, "raw")


@query("grid_offsets", f"""WITH {COLUMNS_SQL}, {_grid_sql(0.02, 'a')}
SELECT box.record, lead, round(CASE WHEN list_contains(string_split(long_leads, ','), lead) THEN 0.0 ELSE (x1 - g0) * 2.5 / pitch END, 6)::DOUBLE AS raw,
       (CASE WHEN list_contains(string_split(long_leads, ','), lead) THEN 0.0 ELSE c * 2.5 END)::DOUBLE AS snapped
FROM box JOIN aout USING (record) WHERE reason IS NULL""")
def grid_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, heights = _boxes(spark, sf_dir)
    fitted = grid.fit_column_grid(boxes, heights).filter("reason IS NULL")
    return rounded(grid.grid_offsets(boxes, fitted), 6, "raw")


# Three event types per user and day as three leads.
LEADS_SQL = """
m(event_type, lead, lead2) AS (VALUES ('view', 'I', 'aVR'), ('click', 'III', 'aVL'), ('purchase', 'II', 'aVF')),
s1 AS (SELECT user_id AS record, lead, lead2, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) % 6 AS t, round(sum(value), 4) AS mv
       FROM events JOIN m USING (event_type) GROUP BY 1, 2, 3, 4),
w AS (SELECT record, t, max(mv) FILTER (WHERE lead = 'I') AS a, max(mv) FILTER (WHERE lead = 'III') AS b,
             max(mv) FILTER (WHERE lead = 'II') AS c FROM s1 GROUP BY 1, 2),
v AS (SELECT *, a + b - c AS r, a + b + c AS q FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL)"""


def _lead_samples(spark: SparkSession, sf_dir: str, all_leads: bool = True) -> DataFrame:
    names = {"view": ("I", "aVR"), "click": ("III", "aVL"), "purchase": ("II", "aVF")}
    lead = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[0])])
    other = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[1])])
    base = (table(spark, sf_dir, "events").filter(F.col("event_type").isin(*names))
            .groupBy(F.col("user_id").alias("record"), "event_type", (day_index() % 6).alias("t"))
            .agg(F.round(F.sum("value"), 4).alias("mv")))
    both = F.explode(F.array(lead[F.col("event_type")], other[F.col("event_type")]) if all_leads
                     else F.array(lead[F.col("event_type")]))
    return base.withColumn("lead", both).drop("event_type")


@query("limb_lead_consistency", f"""WITH {LEADS_SQL},
d AS (SELECT record, median(r) AS mr, median(q) AS mq FROM v GROUP BY record),
g AS (SELECT record, count(*) AS n, sqrt(avg(r * r)) AS r1, sqrt(avg((r - mr) * (r - mr))) AS r2, sqrt(avg(q * q)) AS q1,
             sqrt(avg((q - mq) * (q - mq))) AS q2, (sqrt(avg(a * a)) + sqrt(avg(b * b)) + sqrt(avg(c * c))) / 3 AS lev
      FROM v JOIN d USING (record) GROUP BY record)
SELECT i.record, round(r1, 4) AS einthoven_rms, round(r2, 4) AS einthoven_rms_demedian, round(r1 / lev, 6) AS einthoven_ratio,
       coalesce(n, 0) AS einthoven_n, round(q1, 4) AS goldberger_rms, round(q2, 4) AS goldberger_rms_demedian,
       round(q1 / lev, 6) AS goldberger_ratio, coalesce(n, 0) AS goldberger_n,
       CASE WHEN n IS NULL THEN 'no common sample' WHEN r1 / lev >= 0.1797 THEN 'leads disagree' END AS warning
FROM (SELECT DISTINCT record FROM s1) i LEFT JOIN g USING (record)""")
def limb_lead_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.consistency_warning(grid.consistency(_lead_samples(spark, sf_dir)))
    for rule in ("einthoven", "goldberger"):
        out = rounded(out, 4, f"{rule}_rms", f"{rule}_rms_demedian").withColumn(f"{rule}_ratio", F.round(f"{rule}_ratio", 6))
    return out


@query("baseline_shift", f"""WITH {LEADS_SQL},
d AS (SELECT record, median(r) AS e, median(q) AS g FROM v GROUP BY record),
s AS (SELECT i.record, -g / (3 * 0.5) + e / 0.5 AS gap, -(3 * g + e) / (10 * 0.5) AS sh FROM (SELECT DISTINCT record FROM s1) i LEFT JOIN d USING (record))
SELECT record, round(CASE WHEN gap IS NOT NULL AND abs(gap) <= 0.004 * 20000.5 THEN sh ELSE 0.0 END, 6)::DOUBLE AS shift,
       round(gap, 6) AS disagreement FROM s""")
def baseline_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _lead_samples(spark, sf_dir)
    pages = samples.select("record").distinct().withColumn("pitch", F.lit(20000.5))
    return rounded(grid.baseline_shift(samples, pages, F.lit(0.5)), 6, "shift", "disagreement")


@query("assemble_and_rescale", f"""WITH {LEADS_SQL},
st AS (SELECT record, lead, CASE lead WHEN 'I' THEN 0 WHEN 'III' THEN 5 ELSE 10 END + t AS t, mv FROM s1),
k AS (SELECT * FROM st WHERE t >= 0 AND t < 14),
b AS (SELECT record, min(mv) AS lo, max(mv) AS hi FROM k GROUP BY record)
SELECT record, lead, t, round(CASE WHEN lo < -10 OR hi > 10 THEN 2 * (mv - lo) / CASE WHEN hi > lo THEN hi - lo END - 1 ELSE mv END, 6) AS mv,
       lo < -10 OR hi > 10 AS rescaled FROM k JOIN b USING (record)""")
def assemble_and_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _lead_samples(spark, sf_dir, all_leads=False)
    offsets = samples.select("record", "lead").distinct().withColumn(
        "snapped", F.when(F.col("lead") == "I", 0.0).when(F.col("lead") == "III", 2.5).otherwise(5.0))
    return rounded(grid.rescaled(grid.assemble(samples, offsets, 14, rate=2.0)), 6, "mv")


@query("interpolated_lookup", f"""WITH {DAILY_SQL},
pr AS (SELECT user_id AS record, event_id, round(epoch(ts - TIMESTAMP '2024-01-01') / 86400.0, 6) AS t FROM events),
kn AS (SELECT record, t::DOUBLE AS m0, mv AS x0, lead(t) OVER w AS m1, lead(mv) OVER w AS x1 FROM daily WHERE t % 3 <> 1 AND t > 2
       WINDOW w AS (PARTITION BY record ORDER BY t)),
en AS (SELECT record, min(m0) AS lo, max(m0) AS hi, min_by(x0, m0) AS xlo, max_by(x0, m0) AS xhi FROM kn GROUP BY record)
SELECT pr.record, event_id, pr.t, round(CASE WHEN pr.t < lo THEN xlo + (pr.t - lo) * 1.5 WHEN pr.t > hi THEN xhi + (pr.t - hi) * 1.5
       WHEN pr.t = hi THEN xhi ELSE x0 + (pr.t - m0) * ((x1 - x0) / (m1 - m0)) END, 9) AS mapped
FROM pr LEFT JOIN en USING (record) LEFT JOIN kn ON kn.record = pr.record AND pr.t >= m0 AND pr.t < m1""")
def interpolated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record"), "event_id", F.round(day_fraction(), 6).alias("t"))
    knots = daily(spark, sf_dir).filter("t % 3 <> 1 AND t > 2").withColumn("t", F.col("t").cast("double"))
    return rounded(grid.interpolate(probes, knots, ["record"], "t", "mv", 4.0, slope=1.5), 9, "mapped")


@query("line_fit_gate", """
WITH f AS (SELECT l_suppkey AS k, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i,
                  count(*) AS n, count(DISTINCT l_quantity) AS d FROM lineitem GROUP BY 1),
r AS (SELECT k, s, i, n, d, max(abs(l_extendedprice - i - s * l_quantity)) AS residual FROM f JOIN lineitem ON l_suppkey = k GROUP BY 1, 2, 3, 4, 5)
SELECT k AS supplier, n, round(s, 4) AS slope, round(i, 4) AS intercept, round(residual, 4) AS residual,
       CASE WHEN d < 2 THEN 'one position only' WHEN residual > 45 * abs(s) THEN 'points are off the line' END AS reason FROM r""")
def line_fit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_quantity", "l_extendedprice")
    return rounded(grid.line_fit(points, ["supplier"], "l_quantity", "l_extendedprice", 45.0), 4, "slope", "intercept", "residual")


@query("parallel_line_counts", """
WITH a AS (SELECT label, embedding[1]::DOUBLE AS theta FROM embeddings)
SELECT x.label, x.theta, count(DISTINCT x.theta) * (SELECT count(*) FROM a y WHERE y.label = x.label AND y.theta > x.theta - 0.05 AND y.theta < x.theta + 0.05) AS n_parallel,
       count(*) AS n_lines FROM a x GROUP BY 1, 2""")
def parallel_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("theta"))
    return grid.parallel_counts(angles, ["label"], "theta", 0.05)


@query("median_line_angle", """
SELECT label, round_even(degrees(median(embedding[1]::DOUBLE)) - 90.0, 4) AS angle FROM embeddings GROUP BY label""")
def median_line_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    angles = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("theta"))
    return grid.median_angle(angles, ["label"], "theta")


HEADER_SQL = """
hd AS (SELECT c_custkey, 'cust' || c_custkey || '/3 2 500/100 ' || (5000 + c_nationkey) || ' 10:11:12 01/02/2003' || chr(10)
           || 'cust' || c_custkey || '.dat 16x1+24 ' || (1000 + c_nationkey) || '.5(' || (c_custkey % 7) || ')/uV 16 ' || c_nationkey || ' 5 ' || c_custkey || ' 0 I' || chr(10)
           || 'cust' || (c_custkey % 2) || '.dat 212:4 200 12 -3 7 11 0 AVR' || chr(10) || '# Age: 55' || chr(10)
           || '# Labels: A,  ' || c_mktsegment || chr(10) || '# Labels:' || c_nationkey || ' ' || chr(10) || '# Age:  ' || (c_custkey % 90) AS h
       FROM customer)"""


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    text = F.concat(
        F.lit("cust"), k, F.lit("/3 2 500/100 "), (F.col("c_nationkey") + 5000).cast("string"), F.lit(" 10:11:12 01/02/2003\ncust"),
        k, F.lit(".dat 16x1+24 "), (F.col("c_nationkey") + 1000).cast("string"), F.lit(".5("), (F.col("c_custkey") % 7).cast("string"),
        F.lit(")/uV 16 "), n, F.lit(" 5 "), k, F.lit(" 0 I\ncust"), (F.col("c_custkey") % 2).cast("string"),
        F.lit(".dat 212:4 200 12 -3 7 11 0 AVR\n# Age: 55\n# Labels: A,  "), F.col("c_mktsegment"), F.lit("\n# Labels:"), n,
        F.lit(" \n# Age:  "), (F.col("c_custkey") % 90).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", text.alias("h"))


@query("parse_headers", f"""WITH {HEADER_SQL}
SELECT c_custkey, 'cust' || c_custkey AS name, 2 AS n_signals, 500.0::DOUBLE AS fs,
       CAST(regexp_extract(h, '^[^ ]* [^ ]* [^ ]* ([0-9]+)', 1) AS BIGINT) AS n_samples,
       CASE WHEN c_custkey < 2 AND c_custkey = c_custkey % 2 THEN 'cust' || c_custkey || '.dat'
            ELSE 'cust' || c_custkey || '.dat,cust' || (c_custkey % 2) || '.dat' END AS files, '16,212' AS formats,
       CAST(regexp_extract(h, 'dat 16x1\\+24 ([0-9.]+)\\(', 1) AS DOUBLE) AS gain0, 200.0::DOUBLE AS gain1,
       CAST(regexp_extract(h, '\\(([0-9]+)\\)', 1) AS INTEGER) AS baseline0, -3 AS baseline1, 'uV,mV' AS units,
       CAST(c_custkey AS INTEGER) AS checksum0, 'I,AVR' AS names, 'I,aVR' AS leads,
       regexp_extract_all(h, '# Age: *([0-9]+)', 1)[-1] AS age,
       array_to_string(list_concat(['A'], [regexp_extract(h, '# Labels: A,  ([A-Z]+)', 1)], [trim(regexp_extract(h, '# Labels:([0-9]+)', 1))]), ',') AS labels
FROM hd""")
def parse_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = headers
    return _headers(spark, sf_dir).select(
        "c_custkey", h.record_name("h").alias("name"), h.n_signals("h").alias("n_signals"), h.sampling_frequency("h").alias("fs"),
        h.n_samples("h").alias("n_samples"), F.array_join(h.signal_files("h"), ",").alias("files"),
        F.array_join(h.signal_formats("h"), ",").alias("formats"), h.adc_gains("h")[0].alias("gain0"), h.adc_gains("h")[1].alias("gain1"),
        h.adc_baselines("h")[0].alias("baseline0"), h.adc_baselines("h")[1].alias("baseline1"),
        F.array_join(h.signal_units("h"), ",").alias("units"), h.integer_fields("h", 6)[0].alias("checksum0"),
        F.array_join(h.signal_names("h"), ",").alias("names"), F.array_join(h.lead_names("h"), ",").alias("leads"),
        h.variable("h", "# Age:").alias("age"), F.array_join(h.variables("h", h.LABELS), ",").alias("labels"))


@query("rewrite_headers", f"""WITH {HEADER_SQL}
SELECT c_custkey, regexp_extract(h, '^([^ ]* [^ ]* [^ ]* [0-9]+) ', 1) || ' 01:02:03 ' || strftime(DATE '2024-02-01' + CAST(c_custkey % 50 AS INTEGER), '%d/%m/%Y') || chr(10)
       || regexp_extract(h, '(cust[0-9]+\\.dat 16x[^#]*)' || chr(10) || '#', 1) || chr(10) || '# Sex: ' || CASE WHEN c_custkey % 3 = 0 THEN 'Male' WHEN c_custkey % 3 = 1 THEN 'Female' ELSE 'Unknown' END AS header
FROM hd""")
def rewrite_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = headers.day_first(F.date_add(F.lit("2024-02-01").cast("date"), (F.col("c_custkey") % 50).cast("int")))
    notes = F.array(F.concat(F.lit("# Sex: "), labels.sex_text(F.col("c_custkey") % 3)))
    return _headers(spark, sf_dir).select(
        "c_custkey", headers.rewritten("h", F.lit("01:02:03"), date, notes, ["# Age:", headers.LABELS]).alias("header"))


@query("last_matching_line", """
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, 'The')) AS m FROM documents)
SELECT doc_id, regexp_replace(coalesce(substr(m[-1], 4), ''), '^\\s+|\\s+$', '', 'g') AS value, len(m) > 0 AS found FROM l""")
def last_matching_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", headers.variable("text", "The").alias("value"), headers.has_variable("text", "The").alias("found"))


@query("page_url_fields", """
SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '([0-9]+)[^0-9/]*$', 1) AS INTEGER) AS tail,
       regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def page_url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", r"([0-9]+)[^0-9/]*$", 1).try_cast("int").alias("tail"),
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("image_name_order", """
WITH n AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ['r-' || p_size || '.png', 'r-10.png', 'r-9.png'] ELSE ['r-' || p_size || '.png', 'r-x.png', 'r-9.png'] END AS a FROM part)
SELECT p_partkey, CASE WHEN list_bool_and(list_transform(a, lambda x: TRY_CAST(regexp_extract(x, '-(.*)\\.png', 1) AS DOUBLE) IS NOT NULL))
       THEN array_to_string(list_transform(list_sort(list_transform(a, lambda x: {'k': TRY_CAST(regexp_extract(x, '-(.*)\\.png', 1) AS DOUBLE), 'n': x})), lambda s: s.n), ',')
       ELSE array_to_string(list_sort(a), ',') END AS images FROM n""")
def image_name_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("p_size") % 3 == 0, "r-10.png").otherwise("r-x.png")
    names = F.array(F.concat(F.lit("r-"), F.col("p_size").cast("string"), F.lit(".png")), last, F.lit("r-9.png"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(headers.image_order(names), ",").alias("images"))


@query("number_texts", """
SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS txt FROM events""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", number_text(F.col("value").cast("string")).alias("txt"))


# Codes of a customer: the order priorities and states of their orders, in order of the first order.
CODES_SQL = """
st(code, diagnostic, diagnostic_class) AS (VALUES ('1-URGENT', 1, 'MI'), ('2-HIGH', 1, 'STTC'), ('3-MEDIUM', 1, 'NORM'),
                                              ('4-NOT SPECIFIED', 1, 'MI'), ('5-LOW', 0, 'HYP')),
cd AS (SELECT o_custkey AS ecg_id, o_orderpriority AS code, min(o_orderkey) AS ord FROM orders GROUP BY 1, 2),
fc AS (SELECT ecg_id, diagnostic_class AS cls, min(ord) AS ord FROM cd JOIN st USING (code) WHERE diagnostic = 1 GROUP BY 1, 2)"""


def _codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    codes = (table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ecg_id"), F.col("o_orderpriority").alias("code")).agg(F.min("o_orderkey").alias("ord")))
    statements = spark.createDataFrame(
        [("1-URGENT", 1, "MI"), ("2-HIGH", 1, "STTC"), ("3-MEDIUM", 1, "NORM"), ("4-NOT SPECIFIED", 1, "MI"), ("5-LOW", 0, "HYP")],
        "code string, diagnostic int, diagnostic_class string")
    return codes, statements


@query("superclasses", f"""WITH {CODES_SQL}
SELECT ecg_id, string_agg(cls, ',' ORDER BY ord) AS first_seen, string_agg(cls, ',' ORDER BY cls) AS by_name FROM fc GROUP BY ecg_id""")
def superclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, statements = _codes(spark, sf_dir)
    seen = labels.superclasses(codes, statements, "ecg_id", "ord").select("ecg_id", F.array_join("classes", ",").alias("first_seen"))
    named = labels.superclasses(codes, statements, "ecg_id").select("ecg_id", F.array_join("classes", ",").alias("by_name"))
    return seen.join(named, "ecg_id")


@query("diagnosis_labels", f"""WITH {CODES_SQL},
a AS (SELECT ecg_id, list(code) AS codes FROM cd GROUP BY 1), b AS (SELECT ecg_id, list(cls) AS classes FROM fc GROUP BY 1),
r AS (SELECT a.ecg_id, coalesce(classes, []) AS cl, codes AS co, c_mktsegment AS stx FROM a LEFT JOIN b USING (ecg_id) JOIN customer ON c_custkey = a.ecg_id)
SELECT ecg_id, concat_ws(', ', CASE WHEN list_contains(cl, 'NORM') THEN 'NORM' END, CASE WHEN contains(stx, 'BUILD') THEN 'Acute MI' END,
       CASE WHEN list_contains(cl, 'MI') AND NOT contains(stx, 'BUILD') THEN 'Old MI' END, CASE WHEN list_contains(cl, 'STTC') THEN 'STTC' END,
       CASE WHEN list_contains(co, '5-LOW') THEN 'PAC' END) AS labels FROM r""")
def diagnosis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, statements = _codes(spark, sf_dir)
    lists = codes.withColumn("code", F.when(F.col("code") == "5-LOW", "PAC").otherwise(F.col("code"))).groupBy("ecg_id").agg(
        F.collect_set("code").alias("codes"))
    classes = labels.superclasses(codes, statements, "ecg_id")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ecg_id"), "c_mktsegment")
    rows = lists.join(classes, "ecg_id", "left").join(customers, "ecg_id")
    return rows.select("ecg_id", labels.diagnosis_labels(F.col("classes"), F.col("codes"), F.col("c_mktsegment"), ["BUILD"]).alias("labels"))


@query("split_with_patient_guard", """
WITH r AS (SELECT c_custkey AS id, c_nationkey AS patient, c_custkey % 10 + 1 AS fold, c_acctbal > 0 AS ok FROM customer),
h AS (SELECT DISTINCT patient FROM r WHERE id < 8),
g AS (SELECT id, patient, fold, CASE WHEN fold <= 8 THEN 'Tr' WHEN fold = 9 THEN 'Tv' ELSE 'Ts' END AS grp FROM r WHERE ok)
SELECT id, patient, fold, grp AS "group" FROM g WHERE grp = 'Ts' OR patient NOT IN (SELECT patient FROM h)""")
def split_with_patient_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("patient"), (F.col("c_custkey") % 10 + 1).alias("fold"),
        (F.col("c_acctbal") > 0).alias("ok"))
    held = records.filter("id < 8").select("id")
    return labels.split_records(records, held, "id", "patient", "fold", F.col("ok")).drop("ok")


@query("labels_for_ids", """
SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, coalesce(quality, 0) + coalesce(toxic, 0) > 0 AS labelled,
       coalesce(CAST(l.doc_id % 10 AS INTEGER), -1) AS fold FROM documents d LEFT JOIN labels l USING (doc_id)""")
def labels_for_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = table(spark, sf_dir, "labels").withColumn("fold", (F.col("doc_id") % 10).cast("int"))
    return labels.labels_for(table(spark, sf_dir, "documents").select("doc_id"), db, "doc_id", ["quality", "toxic"], "fold")


@query("cache_misses", """
WITH i AS (SELECT event_id, sha1(props || CAST(user_id AS VARCHAR)) AS digest FROM events),
c AS (SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'stale' ELSE sha1(props || CAST(user_id AS VARCHAR)) END AS digest FROM events WHERE event_id % 4 <> 1)
SELECT i.event_id, i.digest FROM i ANTI JOIN c ON i.event_id = c.event_id AND i.digest = c.digest""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha1(F.concat("props", F.col("user_id").cast("string")))
    inputs = table(spark, sf_dir, "events").select("event_id", digest.alias("digest"))
    cache = inputs.filter("event_id % 4 <> 1").select(
        "event_id", F.when(F.col("event_id") % 5 == 2, "stale").otherwise(F.col("digest")).alias("digest"))
    return labels.cached(inputs, cache, "event_id", "digest")[1]


@query("replace_rows_of_a_key", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'P', round(o_totalprice * 2, 4) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0""")
def replace_rows_of_a_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = old.filter("o_orderstatus = 'P' AND o_orderkey % 2 = 0").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 4))
    return labels.replaced(old, new, ["o_orderstatus"])


@query("best_configuration", """
WITH s AS (SELECT p_brand AS name, avg(p_size) AS score, min(p_partkey) AS ord FROM part GROUP BY 1)
SELECT name, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, ord LIMIT 1""")
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.round(F.avg("p_size"), 9).alias("score"), F.min("p_partkey").alias("ord"))
    return rounded(labels.best_configuration(scores, "name", "score", "ord"), 6, "score")


@query("crossval_folds", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('12345:' || doc_id), doc_id) - 1 AS place, count(*) OVER () AS n
           FROM (SELECT DISTINCT doc_id FROM documents)),
c AS (SELECT *, n // 5 AS base, n % 5 AS longer FROM o)
SELECT doc_id, CAST(CASE WHEN place < longer * (base + 1) THEN place // (base + 1)
                         ELSE longer + (place - longer * (base + 1)) // greatest(base, 1) END AS INTEGER) AS fold FROM c""")
def crossval_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.crossval_folds(table(spark, sf_dir, "documents"), "doc_id")


@query("error_sweep", f"""WITH {READ_SQL}, al(alpha) AS (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0), (4.0)),
b AS (SELECT record, t, alpha, ref, CASE WHEN alpha = 0 THEN ref ELSE (1 - alpha) * ref + alpha * est END AS est FROM pairs CROSS JOIN al WHERE ref IS NOT NULL),
g AS (SELECT record, alpha, count(ref) AS n_ref, count(est) AS n_both, avg(ref * ref) FILTER (WHERE est IS NOT NULL) AS ps,
             avg((ref - est) * (ref - est)) AS pn FROM b GROUP BY 1, 2)
SELECT record, alpha, n_both, round(CASE WHEN pn = 0 THEN CAST('inf' AS DOUBLE) WHEN ps > 0 AND pn > 0 THEN 10 * log10(ps / pn) END * n_both / n_ref, 6) AS snr FROM g""")
def error_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = daily(spark, sf_dir)
    read = reading(series).withColumn("mv", F.when(~F.isnan("mv"), F.col("mv")))
    mixed = labels.scaled_errors(series, read, ["record", "t"], [0.0, 0.5, 1.0, 2.0, 4.0, 1.0])
    out = metrics.signal_snr(mixed, ["record", "alpha"])
    return rounded(out.select("record", "alpha", "n_both", "snr"), 6, "snr")


@query("json_field", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
