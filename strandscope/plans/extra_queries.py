"""Geometry, units, keys, manifests, weighted merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, keys
from ..operators import labels, masks, metrics
from .fixtures import daily, reading, rounded
from .registry import query, table


@query("homography_points", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y FROM embeddings),
w AS (SELECT *, 0.0001 * x - 0.0002 * y + 1.0 AS w FROM p)
SELECT vec_id, round((1.01 * x + 0.02 * y + 3.0) / w, 6) AS x, round((-0.01 * x + 0.99 * y - 2.0) / w, 6) AS y FROM w""")
def homography_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.array(*[F.lit(v) for v in (1.01, 0.02, 3.0, -0.01, 0.99, -2.0, 0.0001, -0.0002, 1.0)])
    px, py = (F.col("embedding")[i].cast("double") * 100.0 for i in (0, 1))
    x, y = arrays.homography(h, px, py)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("rotated_points", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 100 - 10 AS dx, embedding[2]::DOUBLE * 100 - 20 AS dy, radians(label * 3.0) AS a FROM embeddings)
SELECT vec_id, round(10 + dx * cos(a) - dy * sin(a), 6) AS x, round(20 + dx * sin(a) + dy * cos(a), 6) AS y FROM p""")
def rotated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = (F.col("embedding")[i].cast("double") * 100.0 for i in (0, 1))
    x, y = arrays.rotate(px, py, F.lit(10.0), F.lit(20.0), F.col("label") * 3.0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("paper_units", """
SELECT p_partkey, round(p_size / 10.0, 6)::DOUBLE AS volts, round(p_size * 0.04, 6)::DOUBLE AS seconds, round(p_size * 2.54, 6)::DOUBLE AS volts_in,
       round(p_size * 1.016, 6)::DOUBLE AS seconds_in, round(0.01 * pow(greatest(1 - p_size / 60.0, 0), 0.9), 9)::DOUBLE AS rate FROM part""")
def paper_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    out = table(spark, sf_dir, "part").select(
        "p_partkey", arrays.mm_to_volts(n).alias("volts"), arrays.mm_to_seconds(n).alias("seconds"),
        arrays.inches_to_volts(n).alias("volts_in"), arrays.inches_to_seconds(n).alias("seconds_in"),
        F.round(arrays.polynomial_rate(n, 0.01, 60), 9).alias("rate"))
    return rounded(out, 6, "volts", "seconds", "volts_in", "seconds_in")


@query("resampled_shapes", """
SELECT p_partkey, CAST(round_even(p_size * 0.5 / 0.8, 0) AS INTEGER) AS h, CAST(round_even((p_size + 7) * 1.5 / 0.8, 0) AS INTEGER) AS w FROM part""")
def resampled_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.array(F.col("p_size"), F.col("p_size") + 7)
    new = arrays.resampled_shape(shape, F.array(F.lit(0.5), F.lit(1.5)), F.array(F.lit(0.8), F.lit(0.8)))
    return table(spark, sf_dir, "part").select("p_partkey", new[0].alias("h"), new[1].alias("w"))


@query("input_keys", """
SELECT event_id, 'gen/' || CAST(user_id AS VARCHAR) || '/' || CASE event_id % 3 WHEN 0 THEN 'masked' WHEN 1 THEN 'dig' ELSE 'err_a2.5' END AS error_key,
       'ptbxl500/' || user_id || '/' || CASE WHEN event_id % 2 = 0 THEN 'layout' ELSE 'noise22.0_s7_l' || (event_id % 4) END AS noise_key FROM events""")
def input_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = F.when(F.col("event_id") % 3 == 0, 0.0).when(F.col("event_id") % 3 == 1, 1.0).otherwise(2.5)
    snr = F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(22.0)
    return table(spark, sf_dir, "events").select(
        "event_id", keys.error_key(F.lit("gen"), F.col("user_id").cast("string"), alpha).alias("error_key"),
        keys.noise_key("user_id", snr, 7, F.col("event_id") % 4).alias("noise_key"))


@query("training_manifest", """
WITH f AS (SELECT 'root/' || (c_custkey % 7) || '/' || CASE WHEN c_custkey < 10000 THEN lpad(CAST(c_custkey AS VARCHAR), 5, '0') ELSE CAST(c_custkey AS VARCHAR) END || '_hr-' || k || '.png' AS path
           FROM customer CROSS JOIN (SELECT unnest(range(0, 2)) AS k)),
d AS (SELECT c_custkey AS id, c_custkey % 12 + 1 AS fold FROM customer WHERE c_custkey % 5 <> 3)
SELECT path, id, CASE WHEN fold <= 8 THEN 'Tr' WHEN fold = 9 THEN 'Tv' ELSE 'Ts' END AS "group"
FROM f JOIN d ON CAST(regexp_extract(path, '([0-9]{5,})_hr', 1) AS BIGINT) = id WHERE fold <= 10""")
def training_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").select("c_custkey")
    path = F.concat(F.lit("root/"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"), F.when(F.col("c_custkey") < 10_000, F.lpad(F.col("c_custkey").cast("string"), 5, "0")).otherwise(F.col("c_custkey").cast("string")),
                    F.lit("_hr-"), F.col("k").cast("string"), F.lit(".png"))
    files = ids.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(path.alias("path"))
    folds = ids.filter("c_custkey % 5 <> 3").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 12 + 1).alias("fold"))
    found = files.withColumn("id", labels.id_in_path(F.col("path")).cast("bigint")).join(folds, "id")
    return found.select("path", "id", labels.fold_group(F.col("fold")).alias("group")).filter(F.col("group").isNotNull())


@query("merged_tiles", """
SELECT l_orderkey AS place, l_linenumber AS label, round(sum(l_discount * l_quantity) / sum(l_quantity), 11) AS score FROM lineitem GROUP BY 1, 2""")
def merged_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("place"), F.col("l_linenumber").alias("label"), F.col("l_discount").alias("score"), "l_quantity")
    return rounded(masks.merge_tiles(tiles, ["place"], "label", "score", "l_quantity"), 11, "score")


@query("soft_confusion", """
WITH c AS (SELECT l_returnflag AS k, l_discount * 10 AS p, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
s AS (SELECT k, sum(p * y) AS tp, sum(p * (1 - y)) AS fp, sum((1 - p) * y) AS fn, sum((1 - p) * (1 - y)) AS tn FROM c GROUP BY k)
SELECT k, round(tp, 3)::DOUBLE AS tp, round(fp, 3)::DOUBLE AS fp, round(fn, 3)::DOUBLE AS fn, round(tn, 3)::DOUBLE AS tn,
       round(2 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS dice FROM s""")
def soft_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("k"), (F.col("l_discount") * 10).alias("p"), (F.col("l_linestatus") == "O").alias("y"))
    return rounded(rounded(masks.soft_confusion(cells, ["k"], "p", "y"), 3, "tp", "fp", "fn", "tn"), 6, "dice")


@query("weighted_difference")
def weighted_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = daily(spark, sf_dir)
    pairs = metrics.sample_pairs(series, reading(series), ["record"])
    return rounded(metrics.weighted_difference(pairs, ["record"], 50), 6, "weighted_difference")
