"""Label masks: drawing, overlap, boxes, confusion counts, components, intensities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import masks
from ..operators.ordered import beside
from .fixtures import hour_index, rounded
from .registry import query, table

TYPES = ("view", "click", "purchase", "signup", "error")

# Pages: ten records, one row per ten users, one column per hour, the event type as label.
RASTER_SQL = """
types(label, name) AS (VALUES (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'signup'), (5, 'error'), (6, 'absent')),
ev AS (SELECT user_id % 10 AS record, user_id // 10 AS row, CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS col,
              label, event_id FROM events JOIN types ON name = event_type),
gt AS (SELECT record, row, col, max(label) AS label FROM ev WHERE event_id % 3 <> 0 GROUP BY 1, 2, 3),
pred AS (SELECT record, row, col + event_id % 2 AS col, max(label) AS label FROM ev
         WHERE event_id % 4 <> 0 AND label <> 2 GROUP BY 1, 2, 3)"""


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1,) for i in range(6)], "label int")


def _rasters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = F.array(*[F.lit(t) for t in TYPES])
    ev = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("record"), F.floor(F.col("user_id") / 10).alias("row"),
        hour_index().alias("col"),
        F.array_position(names, F.col("event_type")).cast("int").alias("label"), "event_id")
    gt = ev.filter("event_id % 3 <> 0").groupBy("record", "row", "col").agg(F.max("label").alias("label"))
    moved = ev.filter("event_id % 4 <> 0 AND label <> 2").withColumn("col", F.col("col") + F.col("event_id") % 2)
    return gt, moved.groupBy("record", "row", "col").agg(F.max("label").alias("label"))


# Polylines: successive pairs of embedding elements as points on a 20 x 30 page.
POINTS_SQL = """
pts AS (SELECT label AS record, vec_id AS lead_order, vec_id % 12 + 1 AS label, k,
               embedding[2 * k + 1]::DOUBLE * 60 AS row, embedding[2 * k + 2]::DOUBLE * 80 AS col
        FROM embeddings CROSS JOIN (SELECT unnest(range(0, 32)) AS k)),
nx AS (SELECT *, lead(row) OVER w AS nrow, lead(col) OVER w AS ncol FROM pts
       WINDOW w AS (PARTITION BY record, lead_order ORDER BY k)),
dense AS (SELECT record, lead_order, label, k, step,
                 CASE WHEN step = 3 THEN nrow ELSE row + step * ((nrow - row) / 3.0) END AS row,
                 CASE WHEN step = 3 THEN ncol ELSE col + step * ((ncol - col) / 3.0) END AS col
          FROM nx CROSS JOIN (SELECT unnest(range(0, 4)) AS step) WHERE nrow IS NOT NULL),
px AS (SELECT record, lead_order, label, k, step, CAST(trunc(row) AS INTEGER) AS row, CAST(trunc(col) AS INTEGER) AS col
       FROM dense)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(
        k.alias("k"), (F.get(F.col("embedding"), 2 * k).cast("double") * 60.0).alias("row"),
        (F.get(F.col("embedding"), 2 * k + 1).cast("double") * 80.0).alias("col")))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("record"), F.col("vec_id").alias("lead_order"),
        (F.col("vec_id") % 12 + 1).alias("label"), F.inline(pairs))


@query("densify_points", f"""WITH {POINTS_SQL}
SELECT record, lead_order, label, k, step, round(row, 6) AS row, round(col, 6) AS col FROM dense""")
def densify_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masks.densify(_points(spark, sf_dir), ["record", "lead_order"], "k", 4), 6, "row", "col")


@query("rasterise_points", f"""WITH {POINTS_SQL}
SELECT record, row, col, max_by(label, lead_order) AS label FROM px
WHERE row >= 0 AND col >= 0 AND row < 20 AND col < 30 GROUP BY 1, 2, 3""")
def rasterise_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = masks.densify(_points(spark, sf_dir), ["record", "lead_order"], "k", 4)
    return masks.rasterise(dense, F.lit(20), F.lit(30))


@query("rasterise_wrapping", f"""WITH {POINTS_SQL},
s AS (SELECT record, row, col, max_by(label, (lead_order, k)) AS label, min((lead_order, k)) AS turn
      FROM (SELECT record, lead_order, label, k, CAST(trunc(row) AS INTEGER) AS row, CAST(trunc(col) AS INTEGER) AS col FROM pts)
      WHERE row < 20 AND col < 30 GROUP BY 1, 2, 3)
SELECT record, CASE WHEN row < 0 THEN row + 20 ELSE row END AS row, CASE WHEN col < 0 THEN col + 30 ELSE col END AS col,
       max_by(label, turn) AS label FROM s GROUP BY 1, 2, 3""")
def rasterise_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.rasterise_wrapping(_points(spark, sf_dir), F.lit(20), F.lit(30), ["lead_order", "k"])


@query("point_counts", f"""WITH {POINTS_SQL}
SELECT record, count(*) AS n_points, count(*) FILTER (WHERE row < 0 OR col < 0 OR row >= 20 OR col >= 30) AS n_points_dropped,
       count(*) FILTER (WHERE row < 0 OR col < 0) AS n_points_negative FROM px GROUP BY record""")
def point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = masks.densify(_points(spark, sf_dir), ["record", "lead_order"], "k", 4)
    return masks.point_counts(dense, F.lit(20), F.lit(30))


@query("keep_longest_entry", """
WITH l AS (SELECT o_custkey AS record, o_orderpriority AS name, o_orderkey AS entry, CAST(floor(o_totalprice / 100000) AS BIGINT) AS len FROM orders),
m AS (SELECT record, max(len) AS ml FROM l WHERE name = '2-HIGH' GROUP BY record)
SELECT l.* FROM l LEFT JOIN m USING (record) WHERE name <> '2-HIGH' OR len = ml""")
def keep_longest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("record"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("entry"),
        F.floor(F.col("o_totalprice") / 100000).alias("len"))
    return masks.keep_longest(leads, "record", "name", F.lit("2-HIGH"), F.col("len"))


DICE_SQL = f"""{RASTER_SQL},
off AS (SELECT unnest(range(-1, 2)) AS o),
da AS (SELECT DISTINCT record, label, row + a.o AS row, col + b.o AS col FROM gt, off a, off b),
db AS (SELECT DISTINCT record, label, row + a.o AS row, col + b.o AS col FROM pred, off a, off b),
ids AS (SELECT record, label FROM (SELECT record FROM gt UNION SELECT record FROM pred) CROSS JOIN types),
na AS (SELECT record, label, count(*) AS n FROM gt GROUP BY 1, 2),
nb AS (SELECT record, label, count(*) AS n FROM pred GROUP BY 1, 2),
hit AS (SELECT record, label, count(*) AS n FROM gt JOIN pred USING (record, label, row, col) GROUP BY 1, 2),
pa AS (SELECT record, label, count(*) AS n FROM pred JOIN da USING (record, label, row, col) GROUP BY 1, 2),
pb AS (SELECT record, label, count(*) AS n FROM gt JOIN db USING (record, label, row, col) GROUP BY 1, 2),
c AS (SELECT record, label, coalesce(na.n, 0) AS a, coalesce(nb.n, 0) AS b, coalesce(hit.n, 0) AS h,
             coalesce(pa.n, 0) AS pa, coalesce(pb.n, 0) AS pb
      FROM ids LEFT JOIN na USING (record, label) LEFT JOIN nb USING (record, label) LEFT JOIN hit USING (record, label)
      LEFT JOIN pa USING (record, label) LEFT JOIN pb USING (record, label)),
r AS (SELECT record, label, a AS gt_pixels, b AS pred_pixels, CASE WHEN a + b > 0 THEN 2 * h / (a + b) END AS dice_raw,
             CASE WHEN b > 0 THEN pa / b END AS precision_tol, CASE WHEN a > 0 THEN pb / a END AS recall_tol FROM c),
dice AS (SELECT *, CASE WHEN gt_pixels + pred_pixels = 0 THEN NULL
                        WHEN gt_pixels = 0 OR pred_pixels = 0 OR precision_tol + recall_tol <= 0 THEN 0.0
                        ELSE 2 * precision_tol * recall_tol / (precision_tol + recall_tol) END AS dice_tol FROM r)"""


@query("dice_per_label", f"""WITH {DICE_SQL}
SELECT record, label, gt_pixels, pred_pixels, round(dice_raw, 6) AS dice_raw, round(precision_tol, 6) AS precision_tol,
       round(recall_tol, 6) AS recall_tol, round(dice_tol, 6)::DOUBLE AS dice_tol FROM dice""")
def dice_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masks.dice_per_label(*_rasters(spark, sf_dir), _labels(spark))
    return rounded(out, 6, *masks.MASK_METRICS)


@query("mask_summary", f"""WITH {DICE_SQL},
t AS (SELECT CAST(record AS VARCHAR) AS record, dice_raw, dice_tol, recall_tol, precision_tol FROM dice WHERE gt_pixels + pred_pixels > 0
      UNION ALL SELECT '*', dice_raw, dice_tol, recall_tol, precision_tol FROM dice WHERE gt_pixels + pred_pixels > 0)
SELECT record, count(*) AS n_labels, round(median(dice_raw), 6) AS dice_raw_median, round(median(dice_tol), 6)::DOUBLE AS dice_tol_median,
       round(median(recall_tol), 6) AS recall_tol_median, round(median(precision_tol), 6) AS precision_tol_median
FROM t GROUP BY record""")
def mask_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dice = masks.dice_per_label(*_rasters(spark, sf_dir), _labels(spark))
    return rounded(masks.mask_summary(dice), 6, *[f"{m}_median" for m in masks.MASK_METRICS])


@query("bounding_boxes", f"""WITH {RASTER_SQL},
b AS (SELECT record, label, min(col) AS x1, min(row) AS y1, max(col) AS x2, max(row) AS y2 FROM gt GROUP BY 1, 2)
SELECT r.record, types.label, x1, y1, x2, y2 FROM (SELECT DISTINCT record FROM gt) r CROSS JOIN types
LEFT JOIN b ON b.record = r.record AND b.label = types.label""")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.bounding_boxes(_rasters(spark, sf_dir)[0], _labels(spark))


CONF_SQL = f"""{RASTER_SQL},
ref AS (SELECT * FROM gt WHERE label <> 5), pr AS (SELECT pred.* FROM pred LEFT JOIN gt ON gt.record = pred.record
        AND gt.row = pred.row AND gt.col = pred.col AND gt.label = 5 WHERE gt.label IS NULL),
sz AS (SELECT record, (max(row) + 1) * (SELECT max(col) + 1 FROM (SELECT col FROM gt UNION ALL SELECT col FROM pred)) - count(*) FILTER (WHERE label = 5) AS n_pixels FROM gt GROUP BY record),
rg(region, label) AS (VALUES (1, 1), (2, 2), (7, 1), (7, 2), (7, 3), (8, 4)),
ra AS (SELECT DISTINCT record, region, row, col FROM ref JOIN rg USING (label)),
rb AS (SELECT DISTINCT record, region, row, col FROM pr JOIN rg USING (label)),
f AS (SELECT coalesce(ra.record, rb.record) AS record, coalesce(ra.region, rb.region) AS label,
             ra.record IS NOT NULL AS a, rb.record IS NOT NULL AS b
      FROM ra FULL JOIN rb ON ra.record = rb.record AND ra.region = rb.region AND ra.row = rb.row AND ra.col = rb.col),
c AS (SELECT record, label, count(*) FILTER (WHERE a AND b) AS tp, count(*) FILTER (WHERE b AND NOT a) AS fp,
             count(*) FILTER (WHERE a AND NOT b) AS fn FROM f GROUP BY 1, 2),
k AS (SELECT sz.record, l.label, n_pixels, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn
      FROM sz CROSS JOIN (SELECT DISTINCT region AS label FROM rg) l LEFT JOIN c ON c.record = sz.record AND c.label = l.label),
conf AS (SELECT record, label, tp, fp, fn, n_pixels - tp - fp - fn AS tn,
                CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS dice,
                CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) END AS iou, tp + fp AS n_pred, tp + fn AS n_ref FROM k)"""


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, pred = _rasters(spark, sf_dir)
    ignored = gt.filter("label = 5")
    width = gt.select("col").unionByName(pred.select("col")).agg((F.max("col") + 1).alias("width"))
    heights = gt.groupBy("record").agg((F.max("row") + 1).alias("height"))
    sizes = beside(heights, width).select("record", (F.col("height") * F.col("width")).alias("n_pixels"))
    regions = spark.createDataFrame([(1, 1), (2, 2), (7, 1), (7, 2), (7, 3), (8, 4)], "region int, label int")
    names = regions.select(F.col("region").alias("label")).distinct()
    return masks.confusion_per_label(masks.regions_of(gt, regions), masks.regions_of(pred, regions), sizes, names, ignored)


@query("confusion_per_region", f"""WITH {CONF_SQL}
SELECT record, label, tp, fp, fn, tn, round(dice, 6) AS dice, round(iou, 6) AS iou, n_pred, n_ref FROM conf""")
def confusion_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_confusion(spark, sf_dir), 6, "dice", "iou")


@query("foreground_mean", f"""WITH {CONF_SQL}, m AS (SELECT label, avg(dice) AS dice, avg(iou) AS iou FROM conf GROUP BY label)
SELECT round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou FROM m WHERE label <> 0""")
def foreground_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masks.foreground_mean(_confusion(spark, sf_dir)), 6, "dice", "iou")


@query("ensemble_probabilities", """
WITH m AS (SELECT l_orderkey AS px, CAST(l_partkey % 4 AS INTEGER) AS label, avg(l_discount) AS p FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY px ORDER BY round(p, 9) DESC, label) AS rn FROM m)
SELECT px, label, round(p, 6) AS probability FROM r WHERE rn = 1""")
def ensemble_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("px"), (F.col("l_partkey") % 4).cast("int").alias("label"), F.col("l_discount").alias("p"))
    means = members.groupBy("px", "label").agg(F.round(F.avg("p"), 9).alias("p"))
    return rounded(masks.ensemble(means, ["px"], "label", "p"), 6, "probability")


@query("ensemble_file_check", """
WITH h AS (SELECT user_id, count(DISTINCT event_type) AS n_members FROM events GROUP BY user_id)
SELECT user_id, n_members FROM h WHERE n_members < (SELECT count(DISTINCT event_type) FROM events)""")
def ensemble_file_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.unmatched_members(table(spark, sf_dir, "events"), "event_type", "user_id")


@query("unexpected_labels", f"""WITH {RASTER_SQL}
SELECT record, label, count(*) AS n_pixels FROM gt WHERE label NOT IN (1, 2, 3) GROUP BY 1, 2""")
def unexpected_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(1,), (2,), (3,)], "label int")
    return masks.label_problems(_rasters(spark, sf_dir)[0], expected)


@query("largest_component", f"""WITH RECURSIVE {RASTER_SQL},
d AS (SELECT record, 1 AS label, row, col // 12 AS col FROM gt GROUP BY 1, 3, 4),
comp(record, row, col, root) AS (
    SELECT record, row, col, row * 100000 + col FROM d
    UNION
    SELECT d.record, d.row, d.col, c.root FROM comp c JOIN d ON d.record = c.record
           AND d.row BETWEEN c.row - 1 AND c.row + 1 AND d.col BETWEEN c.col - 1 AND c.col + 1),
m AS (SELECT record, row, col, min(root) AS root FROM comp GROUP BY 1, 2, 3),
s AS (SELECT record, root, count(*) AS n FROM m GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY n DESC, root) AS rn FROM s)
SELECT m.record, 1 AS label, row, col FROM m JOIN b ON b.record = m.record AND b.root = m.root AND b.rn = 1""")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = _rasters(spark, sf_dir)[0]
    coarse = gt.select("record", F.lit(1).alias("label"), "row", F.floor(F.col("col") / 12).alias("col")).distinct()
    return masks.largest_component(coarse)


@query("intensity_fingerprint", """
WITH v AS (SELECT CAST(k AS INTEGER) AS channel, embedding[k + 1]::DOUBLE AS v FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS k))
SELECT channel, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(median(v), 6) AS median, round(quantile_cont(v, 0.005), 6) AS percentile_00_5,
       round(quantile_cont(v, 0.995), 6) AS percentile_99_5 FROM v GROUP BY channel""")
def intensity_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("channel", "v"))
    out = masks.intensity_fingerprint(values, "channel", "v")
    return rounded(out, 6, *[c for c in out.columns if c != "channel"])


@query("normalise_intensity", """
WITH v AS (SELECT vec_id, CAST(k AS INTEGER) AS pos, embedding[k + 1]::DOUBLE AS v FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS k)),
s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi FROM v GROUP BY vec_id)
SELECT vec_id, pos, round((v - m) / greatest(sd, 1e-8), 6) AS z, round((v - lo) / greatest(hi - lo, 1e-8), 6) AS r
FROM v JOIN s USING (vec_id)""")
def normalise_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    z = masks.normalise(values, ["vec_id"], "v", "zscore").withColumnRenamed("normalised", "z")
    r = masks.normalise(z, ["vec_id"], "v", "range").withColumnRenamed("normalised", "r")
    return rounded(r.select("vec_id", "pos", "z", "r"), 6, "z", "r")


@query("normalise_clipped", """
WITH v AS (SELECT vec_id, CAST(k AS INTEGER) AS channel, embedding[k + 1]::DOUBLE AS v FROM embeddings CROSS JOIN (SELECT unnest(range(0, 64)) AS k)),
f AS (SELECT channel, avg(v) AS m, stddev_pop(v) AS sd, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM v GROUP BY channel)
SELECT vec_id, channel, round((least(greatest(v, lo), hi) - m) / greatest(sd, 1e-8), 6) AS normalised FROM v JOIN f USING (channel)""")
def normalise_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("channel", "v"))
    f = masks.intensity_fingerprint(values, "channel", "v")
    out = masks.normalise(values, ["vec_id"], "v", "clip", f)
    return rounded(out.select("vec_id", "channel", "normalised"), 6, "normalised")
