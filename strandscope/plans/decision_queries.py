"""Decisions, flips, ranking measures, margins, bins, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.statistics import exact_interval_column
from ..operators import agreement, pairing, resampling
from .fixtures import READ_SQL, rounded
from .pair_queries import RUNS_SQL, _runs
from .registry import query, table

CLASSES = ("CD", "HYP", "MI", "NORM", "STTC")  # fixed values, in class order
THRESHOLDS = (0.011, -0.021, 0.031, 0.001, 0.052)

# The first five dimensions are the reference scores; the test scores mix in the next five.
LOGITS_SQL = """
dim(class_order, class, thr) AS (VALUES (0, 'CD', 0.011), (1, 'HYP', -0.021), (2, 'MI', 0.031),
                                       (3, 'NORM', 0.001), (4, 'STTC', 0.052)),
logits AS (SELECT vec_id AS record, label, class_order, class, thr::DOUBLE AS thr,
                  embedding[class_order + 1]::DOUBLE AS z_ref,
                  embedding[class_order + 1]::DOUBLE + 0.25::DOUBLE * embedding[class_order + 6]::DOUBLE AS z_test,
                  CASE WHEN label % 5 = class_order OR label % 3 = class_order THEN 1 ELSE 0 END AS y
           FROM embeddings CROSS JOIN dim),
dec AS (SELECT *, z_ref > thr AS dec_ref, z_test > thr AS dec_test, (z_ref > thr) <> (z_test > thr) AS flip,
               abs(1 / (1 + exp(-z_ref)) - 1 / (1 + exp(-z_test))) AS abs_dp FROM logits)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.array(*[F.struct(
        F.lit(i).alias("class_order"), F.lit(c).alias("class"), F.lit(float(t)).alias("thr"),
        F.col("embedding")[i].cast("double").alias("z_ref"),
        (F.col("embedding")[i].cast("double") + F.lit(0.25) * F.col("embedding")[i + 5].cast("double")).alias("z_test"),
        F.when((F.col("label") % 5 == i) | (F.col("label") % 3 == i), 1).otherwise(0).alias("y"))
        for i, (c, t) in enumerate(zip(CLASSES, THRESHOLDS))])
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record"), "label", F.inline(cells))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.with_decisions(logits(spark, sf_dir))


KAPPA_SQL = """CASE WHEN pe >= 1 - 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END"""


@query("decision_summary", f"""WITH {LOGITS_SQL},
s AS (SELECT class, count(DISTINCT record) AS n_records, count(*) AS n_decisions,
             avg(dec_ref::INT) AS pa, avg(dec_test::INT) AS pb, avg((NOT flip)::INT) AS po,
             count(*) FILTER (WHERE flip) AS n_flips, avg(flip::INT) AS flip_rate,
             avg(abs_dp) AS mean_abs_dp, max(abs_dp) AS max_abs_dp, median(abs_dp) AS median_abs_dp
      FROM dec GROUP BY class),
e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s)
SELECT class, n_records, n_decisions, round({KAPPA_SQL}, 6) AS kappa, n_flips, round(flip_rate, 6) AS flip_rate,
       round(mean_abs_dp, 6) AS mean_abs_dp, round(max_abs_dp, 6) AS max_abs_dp,
       round(median_abs_dp, 6) AS median_abs_dp FROM e""")
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.decision_summary(decided(spark, sf_dir), ["class"])
    return rounded(out, 6, "kappa", "flip_rate", "mean_abs_dp", "max_abs_dp", "median_abs_dp")


@query("label_kappa", """
WITH r AS (SELECT l.doc_id, l.quality = 1 AS a, d.n_chars > 400 AS b FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT count(*) AS n, avg(a::INT) AS pa, avg(b::INT) AS pb, avg((a = b)::INT) AS po FROM r),
e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s)
SELECT n, round(CASE WHEN pe >= 1 - 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e""")
def label_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    a, b = F.col("quality") == 1, agreement.decide("n_chars", F.lit(400))
    n = F.count(F.lit(1))
    k = agreement.kappa(n.cast("double"), F.sum(a.cast("double")), F.sum(b.cast("double")), F.sum((a == b).cast("double")))
    return rated.agg(n.alias("n"), F.round(k, 6).alias("kappa"))


RECORD_SQL = f"""{LOGITS_SQL},
rec AS (SELECT record, count(*) FILTER (WHERE flip) AS n_class_flips, bool_or(flip) AS any_flip,
               coalesce(string_agg(class, ';' ORDER BY class_order) FILTER (WHERE flip), '') AS flipped_classes,
               avg(abs_dp) AS mean_abs_dp, max(abs_dp) AS max_abs_dp,
               max(abs(z_test - z_ref)) AS max_abs_dlogit, min(abs(z_ref - thr)) AS min_margin_ref
        FROM dec GROUP BY record)"""


@query("record_flips", f"""WITH {RECORD_SQL}
SELECT record, n_class_flips, any_flip, flipped_classes, round(mean_abs_dp, 6) AS mean_abs_dp,
       round(max_abs_dp, 6) AS max_abs_dp, round(max_abs_dlogit, 6) AS max_abs_dlogit,
       round(min_margin_ref, 6) AS min_margin_ref FROM rec""")
def record_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.record_flips(decided(spark, sf_dir))
    return rounded(out, 6, "mean_abs_dp", "max_abs_dp", "max_abs_dlogit", "min_margin_ref")


@query("record_flip_rate", f"""WITH {RECORD_SQL}
SELECT count(*) AS n_records, count(*) FILTER (WHERE any_flip) AS n_record_flips,
       round(avg(any_flip::INT), 6) AS record_flip_rate FROM rec""")
def record_flip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_record = agreement.record_flips(decided(spark, sf_dir))
    return rounded(agreement.record_flip_rate(per_record), 6, "record_flip_rate")


@query("margin_summary", f"""WITH {RECORD_SQL}
SELECT count(*) AS n, round(avg((min_margin_ref < 0.01)::INT), 6) AS frac_lt_0_01,
       round(avg((min_margin_ref < 0.05)::INT), 6) AS frac_lt_0_05,
       round(quantile_cont(min_margin_ref, 0.25), 6) AS q25_min_margin,
       round(quantile_cont(min_margin_ref, 0.5), 6) AS median_min_margin,
       round(quantile_cont(min_margin_ref, 0.75), 6) AS q75_min_margin FROM rec""")
def margin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.margin_summary(agreement.record_flips(decided(spark, sf_dir)), cuts=(0.01, 0.05))
    return rounded(out, 6, *[c for c in out.columns if c != "n"])


@query("split_halves", f"""WITH {LOGITS_SQL}
SELECT class, round(avg(z_test - z_ref), 6) AS mean_change,
       count(*) FILTER (WHERE record % 2 = 1) AS n_records_odd,
       count(*) FILTER (WHERE record % 2 = 1 AND flip) AS n_flips_odd,
       round(avg(flip::INT) FILTER (WHERE record % 2 = 1), 6) AS flip_rate_odd,
       round(avg(z_test - z_ref) FILTER (WHERE record % 2 = 1), 6) AS mean_change_odd,
       count(*) FILTER (WHERE record % 2 = 0) AS n_records_even,
       count(*) FILTER (WHERE record % 2 = 0 AND flip) AS n_flips_even,
       round(avg(flip::INT) FILTER (WHERE record % 2 = 0), 6) AS flip_rate_even,
       round(avg(z_test - z_ref) FILTER (WHERE record % 2 = 0), 6) AS mean_change_even
FROM dec GROUP BY class""")
def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.split_halves(decided(spark, sf_dir), "record")
    return rounded(out, 6, *[c for c in out.columns if c.startswith(("flip_rate", "mean_change"))])


@query("auroc_support", """
WITH s AS (SELECT d.lang AS lang, d.n_chars AS score, l.quality AS y FROM labels l JOIN documents d USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score)
             + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS rk FROM s),
g AS (SELECT lang, sum(y) AS n_pos, sum(1 - y) AS n_neg, sum(rk) FILTER (WHERE y = 1) AS rs FROM r GROUP BY lang)
SELECT lang, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg,
       round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END, 6) AS auroc
FROM g""")
def auroc_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rounded(agreement.auroc(scored, ["lang"], "n_chars", "quality"), 6, "auroc")


RETENTION_SQL = f"""{LOGITS_SQL},
sc AS (SELECT class, y, 'ref' AS system, z_ref AS z FROM logits UNION ALL
       SELECT class, y, 'test', z_test FROM logits),
rk AS (SELECT *, rank() OVER (PARTITION BY class, system ORDER BY z)
              + (count(*) OVER (PARTITION BY class, system, z) - 1) / 2 AS rk FROM sc),
g AS (SELECT class, system, sum(y) AS n_pos, sum(1 - y) AS n_neg, sum(rk) FILTER (WHERE y = 1) AS rs FROM rk GROUP BY 1, 2),
a AS (SELECT class, system, n_pos, n_neg,
             CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END AS auc FROM g),
w AS (SELECT class, max(auc) FILTER (WHERE system = 'ref') AS auroc_ref, max(auc) FILTER (WHERE system = 'test') AS auroc_test,
             max(n_pos)::BIGINT AS n_pos, max(n_neg)::BIGINT AS n_neg FROM a GROUP BY class)"""


@query("auroc_retention", f"""WITH {RETENTION_SQL}
SELECT class, round(auroc_ref, 6) AS auroc_ref, round(auroc_test, 6) AS auroc_test, n_pos, n_neg,
       round(auroc_test / auroc_ref, 6) AS retention FROM w""")
def auroc_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.auroc_retention(logits(spark, sf_dir)), 6, "auroc_ref", "auroc_test", "retention")


@query("macro_retention", f"""WITH {RETENTION_SQL}
SELECT count(*) AS n_classes, round(avg(auroc_ref), 6) AS macro_ref, round(avg(auroc_test), 6) AS macro_test,
       round(avg(auroc_test) / avg(auroc_ref), 6) AS macro_retention
FROM w WHERE auroc_ref IS NOT NULL AND auroc_test IS NOT NULL""")
def macro_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.macro_retention(agreement.auroc_retention(logits(spark, sf_dir)))
    return rounded(out, 6, "macro_ref", "macro_test", "macro_retention")


@query("youden_thresholds", f"""WITH {LOGITS_SQL},
d AS (SELECT class, z_ref AS score, sum(y) AS pos, sum(1 - y) AS neg FROM logits GROUP BY 1, 2),
c AS (SELECT class, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS n_pos, sum(neg) OVER p AS n_neg
      FROM d WINDOW w AS (PARTITION BY class ORDER BY score DESC), p AS (PARTITION BY class)),
j AS (SELECT *, tp::DOUBLE / n_pos - fp::DOUBLE / n_neg AS j FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY j DESC, score DESC) AS rn FROM j)
SELECT class, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg,
       CASE WHEN j > 0 THEN score ELSE CAST('inf' AS DOUBLE) END AS threshold FROM r WHERE rn = 1""")
def youden_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.youden_thresholds(logits(spark, sf_dir), ["class"], "z_ref", "y")


@query("sensitivity_specificity", f"""WITH {LOGITS_SQL},
c AS (SELECT class, count(*) FILTER (WHERE y = 1 AND dec_test) AS tp, count(*) FILTER (WHERE y = 0 AND dec_test) AS fp,
             count(*) FILTER (WHERE y = 1 AND NOT dec_test) AS fn, count(*) FILTER (WHERE y = 0 AND NOT dec_test) AS tn
      FROM dec GROUP BY class)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity FROM c""")
def sensitivity_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.sensitivity_specificity(decided(spark, sf_dir), ["class"], "dec_test", "y")
    return rounded(out, 6, "sensitivity", "specificity")


CONFUSION_SQL = """
a AS (SELECT DISTINCT o_custkey AS cust, o_orderpriority AS class FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey AS cust, o_orderpriority AS class FROM orders WHERE o_orderstatus = 'O'),
n AS (SELECT count(DISTINCT o_custkey) AS n FROM orders),
f AS (SELECT coalesce(a.class, b.class) AS class, a.cust IS NOT NULL AS l, b.cust IS NOT NULL AS o
      FROM a FULL JOIN b ON a.cust = b.cust AND a.class = b.class),
c AS (SELECT class, count(*) FILTER (WHERE l AND o) AS tp, count(*) FILTER (WHERE NOT l AND o) AS fp,
             count(*) FILTER (WHERE l AND NOT o) AS fn FROM f GROUP BY class),
m AS (SELECT class, tp, fp, fn, n - tp - fp - fn AS tn, 2 * tp / (2 * tp + fp + fn) AS f_measure
      FROM c CROSS JOIN n WHERE tp + fn > 0)"""


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderpriority").alias("class"), "o_orderstatus")
    return agreement.class_confusion(
        orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus = 'O'"), orders, "cust", "class")


@query("class_confusion", f"WITH {CONFUSION_SQL} SELECT class, tp, fp, fn, tn, round(f_measure, 6) AS f_measure FROM m")
def class_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_confusion(spark, sf_dir), 6, "f_measure")


@query("macro_f_measure", f"WITH {CONFUSION_SQL} SELECT count(*) AS n_classes, round(avg(f_measure), 6) AS macro_f FROM m")
def macro_f_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_classes"), F.round(F.avg("f_measure"), 6).alias("macro_f"))


@query("one_hot_classes", """
SELECT o_custkey AS cust, bool_or(o_orderpriority = '1-URGENT') AS "1-URGENT",
       bool_or(o_orderpriority = '2-HIGH') AS "2-HIGH", bool_or(o_orderpriority = '9-NONE') AS "9-NONE"
FROM orders GROUP BY o_custkey""")
def one_hot_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), "o_orderpriority")
    return agreement.one_hot(orders, "cust", "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NONE"])


EDGES = (float("-inf"), -900.0, 0.0, 2000.0, 5000.0, 9000.0, 50000.0, float("inf"))
BINS_SQL = """
bins(bin_lo, bin_hi) AS (VALUES (CAST('-inf' AS DOUBLE), -900.0::DOUBLE), (-900, 0), (0, 2000), (2000, 5000),
                         (5000, 9000), (9000, 50000), (50000, CAST('inf' AS DOUBLE))),
b AS (SELECT bin_lo, bin_hi, count(c_custkey) AS n_rows, count(DISTINCT c_nationkey) AS n_groups,
             count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n_flips, avg(c_acctbal) AS mean_abs_dp
      FROM bins LEFT JOIN customer ON c_acctbal >= bin_lo AND c_acctbal < bin_hi GROUP BY 1, 2)"""


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("flip", F.col("c_mktsegment") == "BUILDING")
    return agreement.flips_per_bin(rows, "c_acctbal", "flip", "c_nationkey", "c_acctbal", EDGES)


@query("flips_per_bin", f"""WITH {BINS_SQL}
SELECT bin_lo, bin_hi, n_rows, n_groups, n_flips,
       round(CASE WHEN n_rows > 0 THEN n_flips / n_rows END, 6) AS record_flip_rate,
       round(mean_abs_dp, 4) AS mean_abs_dp FROM b""")
def flips_per_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_bins(spark, sf_dir), 6, "record_flip_rate").withColumn("mean_abs_dp", F.round("mean_abs_dp", 4))


def _exact_sql(k: str, n: str) -> tuple[str, str]:
    """SQL for both ends of the exact 95 % interval of k out of n: halving an interval until the tail sum is 0.025."""
    def end(first: str, last: str, up: str, edge: str, side: int) -> str:
        mid = "((s[1] + s[2]) / 2)"
        term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({mid}) + ({n} - i) * ln(1 - {mid}))"
        tail = f"list_sum(list_transform(range({first}, {last} + 1), lambda i: {term}))"
        halves = (f"list_reduce(list_concat([[0.0, 1.0]::DOUBLE[]], list_transform(range(50), lambda q: [0.0, 0.0]::DOUBLE[])), "
                  f"lambda s, x: CASE WHEN {tail} {up} 0.025 THEN [{mid}, s[2]] ELSE [s[1], {mid}] END)")
        return f"round(CASE WHEN {n} = 0 THEN NULL WHEN {k} = {edge} THEN {side}.0 ELSE {halves}[1] END, 7)"

    return end(k, n, "<", "0", 0), end("0", k, ">", n, 1)


@query("exact_binomial_interval", f"""WITH {BINS_SQL}
SELECT bin_lo, bin_hi, n_rows, n_flips, {_exact_sql("n_flips", "n_rows")[0]} AS rflip_exact_lo, {_exact_sql("n_flips", "n_rows")[1]} AS rflip_exact_hi FROM b""")
def exact_binomial_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _bins(spark, sf_dir).withColumn("ci", exact_interval_column(F.col("n_flips"), F.col("n_rows")))
    return out.select("bin_lo", "bin_hi", "n_rows", "n_flips",
                      F.round("ci.lo", 7).alias("rflip_exact_lo"), F.round("ci.hi", 7).alias("rflip_exact_hi"))


@query("equal_group_weights", """
WITH n AS (SELECT user_id, count(*) AS c FROM events GROUP BY user_id),
t AS (SELECT sum(c) AS a, count(*) AS g FROM n)
SELECT event_id, user_id, round(a / (c * g), 9) AS weight FROM events JOIN n USING (user_id) CROSS JOIN t""")
def equal_group_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id")
    return rounded(agreement.equal_weights(rows, "user_id"), 9, "weight")


@query("rank_sum_z", f"""WITH {RECORD_SQL},
s AS (SELECT record % 3 = 0 AS g, min_margin_ref AS x FROM rec),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rk FROM s),
t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM s GROUP BY x)),
u AS (SELECT sum(rk) FILTER (WHERE g) - count(*) FILTER (WHERE g) * (count(*) FILTER (WHERE g) + 1) / 2 AS u,
             count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2 FROM r)
SELECT round(u, 6) AS u, round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
       / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM u CROSS JOIN t""")
def rank_sum_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_record = agreement.record_flips(decided(spark, sf_dir)).withColumn("g", (F.col("record") % 3 == 0).cast("int"))
    return rounded(agreement.auroc_pair_p(per_record, "min_margin_ref", "g"), 6, "u", "z")


# Slot s of draw d: a number below m from MD5 of seed, draw and slot.
PICK_SQL = """floor(('0x' || substr(md5('0:' || d || ':' || s), 1, 12))::BIGINT::DOUBLE / 281474976710656::DOUBLE * m::DOUBLE)::BIGINT"""


def _median_sql(n_boot: int, digits: int) -> str:
    """Over v(record, delta): its median and the interval of the medians of n_boot cluster draws."""
    return f"""idx AS (SELECT record, row_number() OVER (ORDER BY record) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT record FROM v)),
picks AS (SELECT d, {PICK_SQL} AS k FROM (SELECT r.d, i.k AS s, i.m FROM range({n_boot}) r(d) CROSS JOIN idx i)),
meds AS (SELECT d, median(delta) AS med FROM picks JOIN idx USING (k) JOIN v USING (record) GROUP BY d)
SELECT (SELECT count(DISTINCT record) FROM v) AS n_clusters, (SELECT count(delta) FROM v) AS n_rows,
       round((SELECT median(delta) FROM v), {digits}) AS median, round(quantile_cont(med, 0.025), {digits}) AS lo,
       round(quantile_cont(med, 0.975), {digits}) AS hi FROM meds"""


@query("bootstrap_median_delta", f"""WITH {READ_SQL},
v AS (SELECT record, est - ref AS delta FROM pairs WHERE ref IS NOT NULL AND est IS NOT NULL),
{_median_sql(200, 6)}""")
def bootstrap_median_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fixtures import daily, reading

    series = daily(spark, sf_dir).withColumn("lead", F.col("t"))
    a = series.withColumnRenamed("mv", "snr_raw")
    b = reading(series).withColumnRenamed("mv", "snr_raw")
    paired = pairing.pair_runs(a, b)
    return rounded(resampling.bootstrap_median(paired, "record", "delta", n_boot=200, seed=0), 6, "median", "lo", "hi")


DRAWN_SQL = f"""idx AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS k, count(*) OVER () AS m FROM each),
picks AS (SELECT d, {PICK_SQL} AS k FROM (SELECT r.d, i.k AS s, i.m FROM range(500) r(d) CROSS JOIN idx i)),
tot AS (SELECT d, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(flips) AS flips, sum(dp) AS dp, sum(anyf) AS anyf, sum(one) AS one
        FROM picks JOIN idx USING (k) GROUP BY d),
stat AS (SELECT *, CASE WHEN pe >= 1 - 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM (
  SELECT *, a / n * (b / n) + (1 - a / n) * (1 - b / n) AS pe, (n - flips) / n AS po FROM tot))"""


@query("bootstrap_kappa", f"""WITH {LOGITS_SQL},
each AS (SELECT record AS cluster, count(*)::DOUBLE AS n, sum(dec_ref::INT) AS a, sum(dec_test::INT) AS b, sum(flip::INT) AS flips,
                0.0 AS dp, 0.0 AS anyf, 1.0 AS one FROM dec GROUP BY 1), {DRAWN_SQL}
SELECT round(quantile_cont(kappa, 0.025), 6) AS lo, round(quantile_cont(kappa, 0.975), 6) AS hi, count(*) AS n_valid FROM stat""")
def bootstrap_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).select(
        "record", F.lit(1.0).alias("n"), F.col("dec_ref").cast("double").alias("a"),
        F.col("dec_test").cast("double").alias("b"), (~F.col("flip")).cast("double").alias("same"))
    draws = resampling.bootstrap_sums(rows, "record", ["n", "a", "b", "same"], n_boot=500, seed=0)
    draws = draws.withColumn("kappa", agreement.kappa(F.col("n"), F.col("a"), F.col("b"), F.col("same")))
    return rounded(resampling.percentile_interval(draws, "kappa"), 6, "lo", "hi")


@query("decision_intervals", f"""WITH {LOGITS_SQL},
rec AS (SELECT record, label AS cluster, count(*)::DOUBLE AS n, sum(dec_ref::INT)::DOUBLE AS a, sum(dec_test::INT)::DOUBLE AS b,
               sum(flip::INT)::DOUBLE AS flips, sum(abs_dp) AS dp, max(flip::INT)::DOUBLE AS anyf, 1.0::DOUBLE AS one FROM dec GROUP BY 1, 2),
each AS (SELECT cluster, sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(flips) AS flips, sum(dp) AS dp, sum(anyf) AS anyf, sum(one) AS one FROM rec GROUP BY 1),
{DRAWN_SQL},
pt AS (SELECT *, CASE WHEN pe >= 1 - 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM (
  SELECT *, a / n * (b / n) + (1 - a / n) * (1 - b / n) AS pe, (n - flips) / n AS po FROM (
    SELECT sum(n) AS n, sum(a) AS a, sum(b) AS b, sum(flips) AS flips, sum(dp) AS dp, sum(anyf) AS anyf, sum(one) AS one FROM each)))
SELECT pt.one::BIGINT AS n_records, pt.flips::BIGINT AS n_flips, NOT pt.flips > 0 AS degenerate, round(pt.kappa, 6) AS kappa,
       {", ".join(f"CASE WHEN pt.flips > 0 OR '{c}' = 'mean_abs_dp' THEN round(q.{c}_{e}, 6) END AS {c}_{e}" for c in ("kappa", "flip_rate", "record_flip_rate", "mean_abs_dp") for e in ("lo", "hi"))},
       round(pt.flips / pt.n, 6) AS flip_rate, round(pt.anyf / pt.one, 6) AS record_flip_rate, round(pt.dp / pt.n, 6) AS mean_abs_dp,
       {_exact_sql("pt.anyf::BIGINT", "pt.one::BIGINT")[0]} AS record_flip_exact_lo, {_exact_sql("pt.anyf::BIGINT", "pt.one::BIGINT")[1]} AS record_flip_exact_hi
FROM pt, (SELECT {", ".join(f"quantile_cont({x}, {p}) AS {c}_{e}" for c, x in (("kappa", "kappa"), ("flip_rate", "flips / n"), ("record_flip_rate", "anyf / one"), ("mean_abs_dp", "dp / n")) for e, p in (("lo", 0.025), ("hi", 0.975)))} FROM stat) q""")
def decision_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.decision_intervals(decided(spark, sf_dir), n_boot=500, seed=0, cluster="label")
    exact = ("record_flip_exact_lo", "record_flip_exact_hi")
    return rounded(rounded(out, 7, *exact), 6, *[c for c in out.columns if c not in ("n_records", "n_flips", "degenerate", *exact)])


@query("bootstrap_auroc_interval", f"""WITH sc AS (
  SELECT l.doc_id, d.lang, d.n_chars AS v, (l.quality = 1)::INT AS p FROM labels l JOIN documents d USING (doc_id)),
idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS m FROM (SELECT DISTINCT doc_id FROM sc)),
picks AS (SELECT d, {PICK_SQL} AS k FROM (SELECT r.d, i.k AS s, i.m FROM range(100) r(d) CROSS JOIN idx i)),
rung AS (SELECT d, lang, v, sum(p) AS p, sum(1 - p) AS q FROM picks JOIN idx USING (k) JOIN sc USING (doc_id) GROUP BY ALL),
lad AS (SELECT *, sum(q) OVER (PARTITION BY d, lang ORDER BY v) - q + q / 2.0 AS below FROM rung),
au AS (SELECT d, lang, sum(p * below) / nullif(sum(p) * sum(q), 0)::DOUBLE AS auroc FROM lad GROUP BY d, lang)
SELECT lang, round(quantile_cont(auroc, 0.025), 6) AS lo, round(quantile_cont(auroc, 0.975), 6) AS hi, count(auroc) AS n_valid
FROM au GROUP BY lang""")
def bootstrap_auroc_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    draws = resampling.bootstrap_auroc(scored, "doc_id", ["lang"], "n_chars", "quality", n_boot=100, seed=0)
    return draws.groupBy("lang").agg(
        F.round(F.percentile("auroc", 0.025), 6).alias("lo"), F.round(F.percentile("auroc", 0.975), 6).alias("hi"),
        F.count("auroc").alias("n_valid"))


@query("flip_logistic")
def flip_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.log1p("value").alias("x"), (F.col("event_type") == "purchase").alias("flip"), "user_id")
    both = [resampling.logistic_fit(rows, "x", "flip", "user_id", weighting=w) for w in ("rows", "group")]
    out = both[0].unionByName(both[1])
    return rounded(out, 6, "x_min", "x_max", "intercept", "slope", "x_at_p0_05", "x_at_p0_1")


@query("bootstrap_price_delta", f"""WITH {RUNS_SQL}, v AS (SELECT record, delta FROM p), {_median_sql(2000, 4)}""")
def bootstrap_price_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster bootstrap of the price deltas with the order as the cluster."""
    paired = pairing.pair_runs(*_runs(spark, sf_dir))
    return rounded(resampling.bootstrap_median(paired, "record", "delta", n_boot=2000, seed=0), 4, "median", "lo", "hi")
