"""Checks of a condition's inputs, digests, sweeps, period hypotheses, robust lines and sessions of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import digests
from ..functions.lead_windows import register_lead_windows
from ..operators import conditions, lines, resampling, robust, signals
from ..operators.ordered import for_each
from ..session import ensure_checkpoint_dir
from ..streaming import arrivals
from ..streaming.sessions import keep_sessions
from . import sweeps
from .fixtures import DAILY_SQL, READ_SQL, daily, day_fraction, reading, rounded
from .registry import query, table
from .trace_queries import PIXEL_SQL, _pixels


def shared(spark: SparkSession) -> str:
    """The folder of the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


# The truth is printed on days of the first half of each week only; one record in five has another original.
CONDITION_SQL = f"""{READ_SQL},
truth AS (SELECT record, 'L' || (record % 3) AS lead, t, CASE WHEN t % 7 < 4 THEN mv END AS mv FROM daily),
orig AS (SELECT record, 'L' || (record % 3) AS lead, t, CASE WHEN record % 5 = 1 AND t > 9 THEN mv + (t % 4) / 8.0 WHEN record % 5 = 2 AND t = 8 THEN NULL ELSE mv END AS mv
         FROM daily WHERE record % 11 <> 3 AND NOT (record % 13 = 4 AND t > 20)),
rd AS (SELECT record, 'L' || (record % 3) AS lead, t, mv FROM reading WHERE record % 17 <> 5)"""


def _condition(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = daily(spark, sf_dir).withColumn("lead", F.concat(F.lit("L"), F.col("record") % 3))
    r, t, mv = F.col("record"), F.col("t"), F.col("mv")
    truth = base.withColumn("mv", F.when(t % 7 < 4, mv))
    changed = F.when((r % 5 == 1) & (t > 9), mv + (t % 4) / 8.0).when((r % 5 == 2) & (t == 8), None).otherwise(mv)
    original = base.filter((r % 11 != 3) & ~((r % 13 == 4) & (t > 20))).withColumn("mv", changed)
    read = reading(daily(spark, sf_dir)).withColumn("lead", F.concat(F.lit("L"), F.col("record") % 3)).filter(r % 17 != 5)
    return truth, original, read


@query("condition_check", f"""WITH {CONDITION_SQL},
j AS (SELECT w.record, w.lead, w.t, w.mv AS a, o.mv AS b, r.t IS NOT NULL AS got FROM truth w LEFT JOIN orig o ON o.record = w.record AND o.t = w.t
      LEFT JOIN (SELECT * FROM rd WHERE NOT isnan(mv)) r ON r.record = w.record AND r.t = w.t WHERE w.mv IS NOT NULL),
f AS (SELECT record, count(*) AS n_window, count(*) FILTER (WHERE b IS NULL OR abs(a - b) > 1e-6) AS n_off, min(t) FILTER (WHERE b IS NULL OR abs(a - b) > 1e-6) AS first_t,
      max(abs(a - b)) AS worst, count(*) FILTER (WHERE got) AS n_read FROM j GROUP BY 1),
sa AS (SELECT record, max(t) + 1 AS n FROM truth GROUP BY 1), sb AS (SELECT record, max(t) + 1 AS n FROM orig GROUP BY 1), sc AS (SELECT record, max(t) + 1 AS n FROM rd GROUP BY 1)
SELECT sa.record, CASE WHEN sb.n IS NULL THEN 'no_original' WHEN sb.n <> sa.n THEN 'other_size' WHEN n_off > 0 THEN 'deviates' WHEN sc.n <> sa.n THEN 'other_reading' END AS reason,
       sc.n IS NOT NULL AS present, coalesce(n_window, 0) AS n_window, coalesce(n_off, 0) AS n_off, first_t, CASE WHEN first_t IS NOT NULL THEN 'L' || (sa.record % 3) END AS first_lead,
       round(worst, 6) AS worst, coalesce(n_read, 0) AS n_read
FROM sa LEFT JOIN sb USING (record) LEFT JOIN sc USING (record) LEFT JOIN f USING (record)""")
def condition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conditions.reconciled(*_condition(spark, sf_dir)), 6, "worst")


@query("condition_inputs", f"""WITH {CONDITION_SQL},
bad AS (SELECT DISTINCT w.record FROM truth w LEFT JOIN orig o ON o.record = w.record AND o.t = w.t WHERE w.mv IS NOT NULL AND (o.mv IS NULL OR abs(o.mv - w.mv) > 1e-6)
        UNION SELECT a.record FROM (SELECT record, max(t) AS n FROM truth GROUP BY 1) a LEFT JOIN (SELECT record, max(t) AS n FROM orig GROUP BY 1) b USING (record) WHERE b.n IS DISTINCT FROM a.n
        UNION SELECT a.record FROM (SELECT record, max(t) AS n FROM truth GROUP BY 1) a JOIN (SELECT record, max(t) AS n FROM rd GROUP BY 1) b USING (record) WHERE b.n <> a.n),
win AS (SELECT record, t FROM truth WHERE mv IS NOT NULL)
SELECT record, lead, t, 'full' AS kind, mv FROM orig WHERE record NOT IN (SELECT record FROM bad)
UNION ALL SELECT record, 'L' || (record % 3), t, 'masked', o.mv FROM win LEFT JOIN orig o USING (record, t) WHERE record NOT IN (SELECT record FROM bad)
UNION ALL SELECT record, 'L' || (record % 3), t, 'read', CASE WHEN isnan(r.mv) THEN NULL ELSE r.mv END FROM win LEFT JOIN rd r USING (record, t) WHERE record NOT IN (SELECT record FROM bad)""")
def condition_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _condition(spark, sf_dir)
    return conditions.masked_inputs(*parts, conditions.reconciled(*parts))


@query("harmonic_period", f"""WITH {PIXEL_SQL},
z AS (SELECT CAST(least(512, width) AS INTEGER) AS l, CAST(8 * least(512, width) AS INTEGER) AS n, width FROM wd),
st AS (SELECT CAST(unnest(range(0, width - l + 1, greatest(l // 2, 1))) AS INTEGER) AS s, l, n FROM z),
x AS (SELECT record, band, s, n, col - s AS k, v - avg(v) OVER (PARTITION BY record, band, s) AS v, 0.5 - 0.5 * cos(2 * pi() * (col - s) / (l - 1)) AS h FROM bp JOIN st ON col >= s AND col < s + l),
bn AS (SELECT CAST(unnest(range(0, n // 2 + 1)) AS INTEGER) AS bin FROM z),
f AS (SELECT record, band, s, bin, sum(v * h * cos(2 * pi() * ((bin * k) % n) / n)) AS re, sum(v * h * sin(2 * pi() * ((bin * k) % n) / n)) AS im FROM x CROSS JOIN bn GROUP BY 1, 2, 3, 4),
p AS (SELECT record, bin, sum(re * re + im * im) AS power FROM f GROUP BY 1, 2),
ls AS (SELECT record, n, list(sqrt(power) ORDER BY bin) AS a, list(power ORDER BY bin) AS pw, greatest(CAST(round_even(0.01 * n, 0) AS INTEGER), 1) AS half FROM p CROSS JOIN z GROUP BY record, n),
pd AS (SELECT *, list_concat(list_transform(range(half), lambda i: a[1]), a, list_transform(range(half), lambda i: a[-1])) AS b FROM ls),
pr AS (SELECT record, n, pw, list_transform(a, lambda q, i: greatest(q - list_aggregate(list_slice(b, i, i + 2 * half), 'median'), 0.0)) AS v FROM pd),
pk AS (SELECT *, list_max(list_slice(v, CAST(ceil(n / 40.0) AS INTEGER) + 1, CAST(floor(n / 3.0) AS INTEGER) + 1)) AS top FROM pr),
pq AS (SELECT *, (CAST(ceil(n / 40.0) AS INTEGER) + list_position(list_slice(v, CAST(ceil(n / 40.0) AS INTEGER) + 1, CAST(floor(n / 3.0) AS INTEGER) + 1), top) - 1) / n::DOUBLE AS peak FROM pk WHERE top > 0),
hy AS (SELECT record, n, v, m, m / (5 * peak) AS cand FROM pq CROSS JOIN (SELECT unnest(range(1, 11)) AS m)),
hv AS (SELECT record, m, cand, k / (5 * cand) AS q, n, v FROM hy CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 10]) AS k) WHERE cand >= 3 AND cand <= 40),
sc AS (SELECT record, m, sum(CASE WHEN q < 0.5 THEN coalesce(list_max(list_slice(v, CAST(ceil(q * (1 - 0.004) * n) AS INTEGER) + 1, CAST(floor(q * (1 + 0.004) * n) AS INTEGER) + 1)), 0) ELSE 0 END) AS score FROM hv GROUP BY 1, 2),
bs AS (SELECT record, max(score) AS best, arg_max(m, struct_pack(s := score, p := -m)) AS m, max(score) FILTER (WHERE m = 5) AS own FROM sc GROUP BY 1),
ch AS (SELECT pq.*, CASE WHEN best < 1.2 * own THEN 5 ELSE m END AS harmonic FROM pq JOIN bs USING (record)),
ce AS (SELECT *, CAST(round_even(5 * peak / harmonic * n, 0) AS INTEGER) AS c FROM ch),
ra AS (SELECT *, greatest(c - 16, 1) AS a, least(c + 17, len(pw) - 1) AS b FROM ce),
sp AS (SELECT record, n, harmonic, pw, a + list_position(list_slice(pw, a + 1, b), list_max(list_slice(pw, a + 1, b))) - 1 AS i FROM ra),
pe AS (SELECT record, harmonic, n / (i + CASE WHEN pw[i] - 2 * pw[i + 1] + pw[i + 2] < 0 THEN 0.5 * (pw[i] - pw[i + 2]) / (pw[i] - 2 * pw[i + 1] + pw[i + 2]) ELSE 0 END) AS period FROM sp),
tr AS (SELECT record, period, harmonic, fc FROM pe CROSS JOIN (SELECT unnest([1.0, 0.93, 0.96, 1.04, 1.07]) AS fc)),
mw AS (SELECT record, band, avg(v) AS m, max(col) + 1 AS w FROM bp GROUP BY 1, 2),
cm AS (SELECT record, band, fc, sqrt(pow(sum(y * cos(g)), 2) + pow(sum(y * sin(g)), 2)) AS z FROM (
  SELECT bp.record, band, fc, (v - m) * (0.5 - 0.5 * cos(2 * pi() * col / (w - 1))) AS y, -2 * pi() * (col + 0.5) / (period * fc) AS g FROM bp JOIN mw USING (record, band) JOIN tr ON tr.record = bp.record) GROUP BY 1, 2, 3),
ct AS (SELECT record, sum(z) FILTER (WHERE fc = 1.0) / greatest(sum(z) FILTER (WHERE fc <> 1.0) / 4, 1e-9) AS contrast FROM cm GROUP BY 1)
SELECT pe.record, CASE WHEN contrast >= 5 THEN round(period, 5) END AS period, harmonic, round(contrast, 4) AS contrast, CASE WHEN contrast < 5 THEN 'no_lines' END AS reason FROM pe JOIN ct USING (record)""")
def harmonic_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.harmonic_period(lines.band_profiles(_pixels(spark, sf_dir), 3))
    return rounded(rounded(out, 5, "period"), 4, "contrast")


_BITS = """CASE WHEN isnan(v) THEN 2143289344 WHEN a = 'inf'::DOUBLE THEN 2139095040 WHEN a = 0 THEN 0
 ELSE (e + 126) * 8388608 + (a * pow(2.0, 23 - e))::BIGINT END + CASE WHEN NOT isnan(v) AND signbit(v) THEN 2147483648 ELSE 0 END"""


@query("input_digests", f"""
WITH i AS (SELECT vec_id, embedding, unnest(embedding) AS v, unnest(range(len(embedding))) AS k FROM embeddings),
s AS (SELECT vec_id, k, v, abs(v::DOUBLE) AS a, CASE WHEN v = 0 OR isnan(v) OR isinf(v) THEN 0 ELSE floor(log2(abs(v::DOUBLE))) END AS l FROM i),
f AS (SELECT vec_id, k, v, a, greatest(CASE WHEN a < pow(2.0, l) THEN l - 1 WHEN a >= 2 * pow(2.0, l) THEN l + 1 ELSE l END, -126)::BIGINT AS e FROM s),
b AS (SELECT vec_id, k, ({_BITS})::BIGINT AS b FROM f),
h AS (SELECT vec_id, string_agg(printf('%02x%02x%02x%02x', b & 255, (b >> 8) & 255, (b >> 16) & 255, (b >> 24) & 255), '' ORDER BY k) AS h FROM b GROUP BY 1)
SELECT vec_id AS key, sha1(unhex(hex(('(' || len(embedding) // 16 || ', 16)')::BLOB) || coalesce(h, ''))) AS sha1 FROM embeddings LEFT JOIN h USING (vec_id)""")
def input_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the prepared inputs, which here are the vectors as tables of 16 columns."""
    vectors = table(spark, sf_dir, "embeddings")
    shape = digests.matrix_shape(F.floor(F.size("embedding") / 16), F.lit(16))
    return vectors.select(F.col("vec_id").alias("key"), digests.array_digest(F.col("embedding"), shape).alias("sha1"))


@query("lead_windows", """
WITH c(lead, k) AS (VALUES ('I', 0), ('II', 0), ('III', 0), ('aVR', 1), ('aVL', 1), ('aVF', 1), ('V1', 2), ('V2', 2), ('V3', 2), ('V4', 3), ('V5', 3), ('V6', 3)),
l AS (SELECT user_id AS record, count(*) AS n FROM events GROUP BY 1), x AS (SELECT record, lead, k, n FROM l CROSS JOIN c),
p AS (SELECT *, unnest(range(CAST(ceil(n / 40.0) AS BIGINT))) AS page FROM x),
s AS (SELECT record, lead, page, false AS strip, page * 40 + k * 10 AS first, 10 AS long, n FROM p UNION ALL SELECT record, lead, page, true, page * 40, 40, n FROM p WHERE lead = 'II')
SELECT record, lead, page::INTEGER AS page, strip, first, least(first + long, n) AS last, (row_number() OVER (PARTITION BY record ORDER BY lead, page, strip) - 1)::INTEGER AS number
FROM s WHERE first < n""")
def lead_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed windows of twelve leads with one sample per event, four samples a second, ten seconds a page."""
    register_lead_windows(spark)
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record")).agg(F.count(F.lit(1)).alias("n"))
    leads = for_each(counts, dims.lead_table(spark).select("lead"))
    return spark.sql("SELECT * FROM lead_windows(TABLE({leads}) PARTITION BY (record) ORDER BY (lead), 4, 10D)", leads=leads)


@query("session_stream", """
WITH e AS (SELECT DISTINCT event_id, user_id, ts, value FROM events),
g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events in order of time, every third one sent twice, as a stream whose sessions are merged into a table."""
    work = f"{shared(spark)}/sessions-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    mark = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), "ts", F.lit(0.0).alias("value"))
    sent = events.unionByName(events.where("event_id % 3 = 0"))
    sent.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{work}/in")
    mark.write.mode("append").parquet(f"{work}/in")  # the end of the stream moves the watermark past every session
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    for _ in range(2):  # the second run replays nothing and adds nothing
        stream = arrivals.arriving_rows(spark, f"{work}/in", kinds)
        keep_sessions(stream.where("user_id IS NOT NULL OR event_id = -1"), f"{work}/out", f"{work}/state", ["user_id", "started"], time="ts", key="user_id", event_id="event_id",
                      value="value", gap="12 hours", lateness="10 days")
    return spark.read.parquet(f"{work}/out").where("user_id IS NOT NULL").select(
        "user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "n", F.round("total", 4).alias("total"))


SWEEP_LEVELS = (30.0, 12.0, 6.0, 0.0)


@query("noise_sweep", """
SELECT record, unnest([0, 1, 2, 3])::INTEGER AS level, unnest([30.0, 12.0, 6.0, 0.0])::DOUBLE AS snr_db, count(*) AS n
FROM (SELECT user_id AS record, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2) GROUP BY record""")
def noise_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record at four levels of noise: the level that the noisy signal shows is the one asked for. Stopped half way and resumed."""
    folder = f"{shared(spark)}/sweep-{uuid.uuid4().hex}"
    samples = daily(spark, sf_dir).withColumn("lead_index", F.lit(0))

    def compute(rows: DataFrame, level: int, snr: float) -> DataFrame:
        noisy = signals.add_band_noise(rows, "record", "lead_index", [snr], seed=7, fs=100.0)
        both = rows.select("record", "t", "mv").join(noisy.select("record", F.col("t").cast("int").alias("t"), F.col("mv").alias("noisy")), ["record", "t"])
        rest = F.sum(F.pow(F.col("noisy") - F.col("mv"), 2))
        return both.groupBy("record").agg((10 * F.log10(F.sum(F.col("mv") * F.col("mv")) / rest)).alias("snr_db"), F.count(F.lit(1)).alias("n"))

    sweeps.sweep(samples, "record", SWEEP_LEVELS, compute, folder, chunks=2, at_most=3)
    out = sweeps.sweep(samples, "record", SWEEP_LEVELS, compute, folder, chunks=2)
    return out.select("record", F.col("level").cast("int").alias("level"), F.round("snr_db", 6).alias("snr_db"), "n")


@query("flip_logistic_draws", "SELECT CAST(unnest(range(0, 40)) AS INTEGER) AS draw, 'ok' AS fit, 0.0::DOUBLE AS score_0, 0.0::DOUBLE AS score_1 FROM (SELECT max(event_id) FROM events)")
def flip_logistic_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of 40 draws of whole users: the equations that define them hold in each."""
    out = resampling.logistic_draws(_flips(spark, sf_dir), "x", "flip", "user_id", n_boot=40, seed=3, weighting="group")
    return out.select("draw", "fit", (F.round("score_0", 8) + 0.0).alias("score_0"), (F.round("score_1", 8) + 0.0).alias("score_1"))


@query("flip_logistic_interval")
def flip_logistic_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = resampling.logistic_draws(_flips(spark, sf_dir), "x", "flip", "user_id", n_boot=40, seed=3)
    out = resampling.logistic_intervals(draws)
    return rounded(out, 6, *[c for c in out.columns if c.endswith(("_lo", "_hi"))])


def _flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.log1p("value").alias("x"), (F.col("event_type") == "purchase").alias("flip"), "user_id")


_TLS = """SELECT u, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM {0} GROUP BY u"""


def _trim_sql() -> str:
    parts, kept = [], "p"
    for i in range(3):
        parts.append(f"l{i} AS ({_TLS.format(kept)})")
        parts.append(f"r{i} AS (SELECT p.u, i, x, y, -sin(a) * (x - mx) + cos(a) * (y - my) AS r, {'true' if i == 0 else f'EXISTS (SELECT 1 FROM {kept} z WHERE z.u = p.u AND z.i = p.i)'} AS old FROM p JOIN l{i} USING (u))")
        parts.append(f"m{i} AS (SELECT u, median(r) AS m FROM r{i} WHERE old GROUP BY u)")
        parts.append(f"w{i} AS (SELECT u, any_value(m) AS m, median(abs(r - m)) AS d FROM r{i} JOIN m{i} USING (u) WHERE old GROUP BY u)")
        parts.append(f"k{i} AS (SELECT u, i, x, y FROM r{i} JOIN w{i} USING (u) WHERE abs(r - m) <= 3 * greatest(1.4826 * d, 0.5))")
        kept = f"k{i}"
    parts.append(f"f AS ({_TLS.format(kept)})")
    return ", ".join(parts)


@query("trimmed_lines", f"""
WITH p AS (SELECT user_id AS u, event_id AS i, epoch(ts) / 86400.0 - 19723 AS x, 2 * (epoch(ts) / 86400.0 - 19723) + ln(1 + value) + CASE WHEN event_id % 9 = 0 THEN 40 ELSE 0 END AS y FROM events),
{_trim_sql()}
SELECT u AS user_id, round(-sin(a), 6) AS nx, round(cos(a), 6) AS ny, round(sin(a) * mx - cos(a) * my, 4) AS "off", round(rms, 5) AS rms, n_kept, n
FROM f JOIN (SELECT k2.u, sqrt(avg(pow(-sin(a) * (x - mx) + cos(a) * (y - my), 2))) AS rms, count(*) AS n_kept FROM k2 JOIN f ON f.u = k2.u GROUP BY 1) USING (u) JOIN (SELECT u, count(*) AS n FROM p GROUP BY 1) USING (u)""")
def trimmed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and a rising value of every user's events, every ninth one far off the line."""
    day = day_fraction()
    points = table(spark, sf_dir, "events").select("user_id", day.alias("x"), (2 * day + F.log1p("value") + F.when(F.col("event_id") % 9 == 0, 40).otherwise(0)).alias("y"))
    out = robust.trimmed_line(points, ["user_id"], "x", "y")
    return rounded(rounded(rounded(out, 6, "nx", "ny"), 4, "off"), 5, "rms").select("user_id", "nx", "ny", "off", "rms", "n_kept", "n")


@query("consensus_lines", """
WITH p AS (SELECT user_id AS u, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER)::DOUBLE AS x, round(ln(1 + sum(value)), 3) AS y FROM events GROUP BY 1, 2),
c AS (SELECT a.u, a.x AS xa, b.x AS xb, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS c FROM p a JOIN p b ON a.u = b.u AND a.x < b.x),
s AS (SELECT c.u, xa, xb, m, c, count(*) FILTER (WHERE abs(y - (m * x + c)) / sqrt(1 + m * m) <= 0.5) AS k, coalesce(sum(abs(y - (m * x + c)) / sqrt(1 + m * m)) FILTER (WHERE abs(y - (m * x + c)) / sqrt(1 + m * m) <= 0.5), 0) AS d
      FROM c JOIN p ON p.u = c.u GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY k DESC, round(d, 9), xa, xb) = 1)
SELECT b.u AS user_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept, count(*) AS n_agree, any_value(n) AS n
FROM b JOIN p ON p.u = b.u AND abs(y - (m * x + c)) / sqrt(1 + m * m) <= 0.5 JOIN (SELECT u, count(*) AS n FROM p GROUP BY 1) q ON q.u = b.u GROUP BY 1""")
def consensus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = daily(spark, sf_dir).select("record", "t", F.round(F.log1p("mv"), 3).alias("y"))
    out = robust.consensus_line(points.withColumn("x", F.col("t").cast("double")), ["record"], "t", "x", "y", 0.5)
    return rounded(rounded(out, 6, "slope"), 5, "intercept").withColumnRenamed("record", "user_id")


@query("change_points", f"""WITH {DAILY_SQL},
p AS (SELECT record, t, mv / 100 AS a, CASE WHEN t > 12 + record % 7 THEN 3.0 ELSE 0.0 END + sin(t) AS b FROM daily),
s AS (SELECT record, row_number() OVER w AS k, count(*) OVER (PARTITION BY record) AS n, sum(a) OVER w AS sa, sum(b) OVER w AS sb, sum(a * a + b * b) OVER w AS q,
      sum(a) OVER (PARTITION BY record) AS ta, sum(b) OVER (PARTITION BY record) AS tb, sum(a * a + b * b) OVER (PARTITION BY record) AS tq FROM p
      WINDOW w AS (PARTITION BY record ORDER BY t ROWS UNBOUNDED PRECEDING)),
c AS (SELECT record, k, q - (sa * sa + sb * sb) / k + (tq - q) - ((ta - sa) * (ta - sa) + (tb - sb) * (tb - sb)) / (n - k) AS sse, tq - (ta * ta + tb * tb) / n AS whole FROM s WHERE k < n AND k >= 3 AND k <= 25)
SELECT record, k AS split, round(sse, 5) AS sse, round(whole, 5) AS sse_whole FROM c QUALIFY row_number() OVER (PARTITION BY record ORDER BY sse, k) = 1""")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily(spark, sf_dir).select("record", "t", (F.col("mv") / 100).alias("a"), (F.when(F.col("t") > 12 + F.col("record") % 7, 3.0).otherwise(0.0) + F.sin("t")).alias("b"))
    return rounded(robust.best_split(rows, ["record"], "t", ["a", "b"], F.lit(3), F.lit(25)), 5, "sse", "sse_whole")
