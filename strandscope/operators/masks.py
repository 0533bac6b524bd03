"""Label masks as sparse pixel tables: one row per (record, row, col) with a label.

Printed traces are thin, so the sparse form is far smaller than the page, and every
operator is a join or an aggregate on pixel coordinates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, finite, ratio
from ..session import pinned
from .ordered import attach, beside, for_each, neighbourhood
from .quantiles import exact_quantiles

PIXEL = ("row", "col")
TILE = 128  # side of the squares in which pixels are joined up at once


def densify(points: DataFrame, keys: Sequence[str], k: str, factor: int) -> DataFrame:
    """Evenly spaced points between consecutive ones, both ends included.

    `k` numbers the points of a polyline from 0 without holes. N points give
    (N - 1) x factor points; joints appear twice. A single point, or a factor of at
    most 1, is left as it is. The result gains `step` (position within a segment).
    """
    if factor <= 1:
        return points.withColumn("step", F.lit(0))
    rows = neighbourhood(points, keys, k, 1, lambda w: {
        "_next": F.lead(F.struct(*PIXEL)).over(w), "_first": F.lag(F.lit(1)).over(w).isNull()})
    single = F.col("_first") & F.col("_next").isNull()
    steps = F.when(single, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    rows = rows.filter(F.col("_next").isNotNull() | single).withColumn("step", F.explode(steps))

    def between(c: str) -> Column:
        p, q = F.col(c), F.col(f"_next.{c}")
        inner = p + F.col("step") * ((q - p) / F.lit(float(factor - 1)))
        return F.when(single, p).when(F.col("step") == factor - 1, q).otherwise(inner)

    return rows.select(*[between(c).alias(c) if c in PIXEL else F.col(c) for c in points.columns], "step")


def keep_longest(leads: DataFrame, record: str, name: str, full_name: Column, length: Column) -> DataFrame:
    """Of the entries of the rhythm lead only the longest ones (all of equal length)."""
    mine = F.coalesce(F.col(name) == full_name, F.lit(False))
    longest = leads.filter(mine).groupBy(record).agg(F.max(length).alias("_longest"))
    return (leads.join(longest, record, "left")
            .filter(~mine | (length == F.col("_longest"))).drop("_longest"))


def rasterise(points: DataFrame, height: Column, width: Column, label: str = "label", order: str = "lead_order",
              record: str = "record") -> DataFrame:
    """Pixels of the points, truncated towards zero; outside ones drop, the later lead wins."""
    row, column = F.col("row").cast("int"), F.col("col").cast("int")
    px = points.select(record, row.alias("row"), column.alias("col"), label, order,
                       height.alias("_h"), width.alias("_w"))
    px = px.filter((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("_h")) & (F.col("col") < F.col("_w")))
    return px.groupBy(record, *PIXEL).agg(F.max_by(label, order).alias(label))


def rasterise_wrapping(points: DataFrame, height: Column, width: Column, order: Sequence[str],
                       label: str = "label", record: str = "record") -> DataFrame:
    """The training variant: negative coordinates count from the far edge, the last point wins.

    Points are first reduced per signed coordinate, in writing order, as two different
    coordinates can name one pixel; the coordinate written first keeps its turn.
    """
    row, column = F.col("row").cast("int"), F.col("col").cast("int")
    px = points.select(record, row.alias("_r"), column.alias("_c"), label, F.struct(*order).alias("_o"),
                       height.alias("_h"), width.alias("_w"))
    px = px.filter((F.col("_r") < F.col("_h")) & (F.col("_c") < F.col("_w")))
    turns = px.groupBy(record, "_r", "_c", "_h", "_w").agg(
        F.max_by(label, "_o").alias(label), F.min("_o").alias("_turn"))
    wrapped = turns.select(record, F.when(F.col("_r") < 0, F.col("_r") + F.col("_h")).otherwise(F.col("_r")).alias("row"),
                           F.when(F.col("_c") < 0, F.col("_c") + F.col("_w")).otherwise(F.col("_c")).alias("col"),
                           label, "_turn")
    return wrapped.groupBy(record, *PIXEL).agg(F.max_by(label, "_turn").alias(label))


def point_counts(points: DataFrame, height: Column, width: Column, record: str = "record") -> DataFrame:
    """Points per record, those off the page, and those with a negative coordinate."""
    row, column = F.col("row").cast("int"), F.col("col").cast("int")
    negative = (row < 0) | (column < 0)
    return points.groupBy(record).agg(
        F.count(F.lit(1)).alias("n_points"),
        count_where(negative | (row >= height) | (column >= width)).alias("n_points_dropped"),
        count_where(negative).alias("n_points_negative"))


def dilate(mask: DataFrame, tolerance: int, by: Sequence[str] = ("record", "label")) -> DataFrame:
    """Pixels within `tolerance` rows and columns of a mask pixel."""
    if tolerance <= 0:
        return mask.select(*by, *PIXEL)
    reach = F.sequence(F.lit(-tolerance), F.lit(tolerance))
    return (mask.select(*by, *PIXEL)
            .withColumn("_dr", F.explode(reach)).withColumn("_dc", F.explode(reach))
            .select(*by, (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"))
            .distinct())


def dice_per_label(gt: DataFrame, pred: DataFrame, labels: DataFrame, tolerance: int = 1) -> DataFrame:
    """Plain and tolerant overlap of two masks per (record, label).

    `labels` lists the labels to report. A label in neither mask has NULL metrics; a
    label in only one has overlap 0 and leaves the undefined ratio NULL.
    """
    by = ["record", "label"]
    spot = [*by, *PIXEL]
    a = gt.select(*spot).withColumn("_a", F.lit(1))
    b = pred.select(*spot).withColumn("_b", F.lit(1))
    both = a.join(b, spot, "full_outer")
    near_a = dilate(gt, tolerance).withColumn("_na", F.lit(1))
    near_b = dilate(pred, tolerance).withColumn("_nb", F.lit(1))
    marked = both.join(near_a, spot, "left").join(near_b, spot, "left")
    is_a, is_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    counts = marked.groupBy(*by).agg(
        count_where(is_a).alias("gt_pixels"), count_where(is_b).alias("pred_pixels"),
        count_where(is_a & is_b).alias("_hit"),
        count_where(is_b & F.col("_na").isNotNull()).alias("_near_gt"),
        count_where(is_a & F.col("_nb").isNotNull()).alias("_near_pred"))
    records = gt.select("record").union(pred.select("record")).distinct()
    zero = F.lit(0).cast("bigint")
    full = for_each(records, labels.select("label")).join(counts, by, "left")
    full = full.select(*by, *[F.coalesce(c, zero).alias(c) for c in ("gt_pixels", "pred_pixels")],
                       "_hit", "_near_gt", "_near_pred")
    out = full.withColumns({
        "dice_raw": ratio(2 * F.col("_hit"), F.col("gt_pixels") + F.col("pred_pixels")),
        "precision_tol": ratio("_near_gt", "pred_pixels"), "recall_tol": ratio("_near_pred", "gt_pixels")})
    p, r = F.col("precision_tol"), F.col("recall_tol")
    empty = (F.col("gt_pixels") == 0) & (F.col("pred_pixels") == 0)
    dice_tol = F.when(empty, F.lit(None).cast("double")).when(p.isNull() | r.isNull() | (p + r <= 0), 0.0).otherwise(
        2.0 * p * r / F.when(p + r > 0, p + r))
    return out.withColumn("dice_tol", dice_tol).drop("_hit", "_near_gt", "_near_pred")


MASK_METRICS = ("dice_raw", "dice_tol", "recall_tol", "precision_tol")


def mask_summary(dice: DataFrame, overall: str = "*") -> DataFrame:
    """Medians over the labels present, per record and over everything."""
    there = dice.filter((F.col("gt_pixels") > 0) | (F.col("pred_pixels") > 0))
    tagged = there.withColumn("record", F.explode(F.array(F.col("record").cast("string"), F.lit(overall))))
    counts = tagged.groupBy("record").agg(F.count(F.lit(1)).alias("n_labels"))
    return counts.join(exact_quantiles(tagged, ["record"], {m: m for m in MASK_METRICS}), "record", "left")


def bounding_boxes(mask: DataFrame, labels: DataFrame) -> DataFrame:
    """First and last row and column per label; labels that are absent keep NULLs."""
    boxes = mask.groupBy("record", "label").agg(
        F.min("col").alias("x1"), F.min("row").alias("y1"), F.max("col").alias("x2"), F.max("row").alias("y2"))
    every = for_each(mask.select("record").distinct(), labels.select("label"))
    return every.join(boxes, ["record", "label"], "left")


def regions_of(mask: DataFrame, regions: DataFrame) -> DataFrame:
    """Masks of regions, each a set of labels: `regions` has one row per (region, label)."""
    return mask.join(F.broadcast(regions), "label").select(
        "record", F.col("region").alias("label"), *PIXEL).distinct()


def confusion_per_label(ref: DataFrame, pred: DataFrame, sizes: DataFrame, labels: DataFrame,
                        ignored: DataFrame | None = None) -> DataFrame:
    """TP / FP / FN / TN, Dice and IoU per (record, label); `sizes` has the pixels of a page.

    `ignored` lists pixels (record, row, col) that count nowhere.
    """
    spot = ["record", "label", *PIXEL]
    if ignored is not None:
        skip = ignored.select("record", *PIXEL).distinct()
        ref, pred = (m.join(skip, ["record", *PIXEL], "left_anti") for m in (ref, pred))
        sizes = (sizes.join(skip.groupBy("record").agg(F.count(F.lit(1)).alias("_skip")), "record", "left")
                 .select("record", (F.col("n_pixels") - F.coalesce("_skip", F.lit(0))).alias("n_pixels")))
    a = ref.select(*spot).withColumn("_a", F.lit(1))
    b = pred.select(*spot).withColumn("_b", F.lit(1))
    is_a, is_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    counts = a.join(b, spot, "full_outer").groupBy("record", "label").agg(
        count_where(is_a & is_b).alias("tp"), count_where(~is_a & is_b).alias("fp"),
        count_where(is_a & ~is_b).alias("fn"))
    zero = F.lit(0).cast("bigint")
    full = for_each(sizes, labels.select("label")).join(counts, ["record", "label"], "left")
    full = full.select("record", "label", "n_pixels", *[F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn")])
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return full.select(
        "record", "label", "tp", "fp", "fn", (F.col("n_pixels") - union).alias("tn"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("dice"),
        ratio("tp", union).alias("iou"),
        (F.col("tp") + F.col("fp")).alias("n_pred"), (F.col("tp") + F.col("fn")).alias("n_ref"))


def foreground_mean(per_case: DataFrame, metrics: Sequence[str] = ("dice", "iou"), background: int = 0) -> DataFrame:
    """Mean over cases per label first, then the plain mean over the labels."""
    per_label = per_case.groupBy("label").agg(*[F.avg(m).alias(m) for m in metrics])
    return per_label.filter(F.col("label") != background).agg(*[F.avg(m).alias(m) for m in metrics])


def ensemble(members: DataFrame, pixel: Sequence[str], label: str, probability: str) -> DataFrame:
    """Mean probability of the members per (pixel, label) and the label with the highest mean."""
    means = members.groupBy(*pixel, label).agg(F.avg(probability).alias("_p"))
    best = means.groupBy(*pixel).agg(F.max(F.struct("_p", (-F.col(label)).alias("_first"), label)).alias("_b"))
    return best.select(*pixel, F.col(f"_b.{label}").alias(label), F.col("_b._p").alias("probability"))


def unmatched_members(listing: DataFrame, member: str, name: str) -> DataFrame:
    """Files that some members of an ensemble lack (an empty result is required to go on)."""
    members = listing.agg(F.countDistinct(member).alias("_m"))
    held = listing.groupBy(name).agg(F.countDistinct(member).alias("n_members"))
    return beside(held, members).filter(F.col("n_members") < F.col("_m")).drop("_m")


def label_problems(mask: DataFrame, expected: DataFrame) -> DataFrame:
    """Labels found in a mask that are not expected, with their pixel counts."""
    return (mask.filter(F.col("label") != 0).join(F.broadcast(expected.select("label")), "label", "left_anti")
            .groupBy("record", "label").agg(F.count(F.lit(1)).alias("n_pixels")))


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes is linked with."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _tile_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of each tile by itself: its cells (row * TILE + col) in order and the first cell of the part of each."""
    wide = TILE + 2  # a free column on either side and a free row below keep rows and tiles apart
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            sizes = np.diff(batch.column("cells").offsets.to_numpy())
            cell = batch.column("cells").flatten().to_numpy()
            key = (np.repeat(np.arange(sizes.size), sizes) * (TILE + 1) + cell // TILE) * wide + cell % TILE + 1
            order = np.argsort(key)
            key, cell = key[order], cell[order]
            links = []
            for step in (1, wide - 1, wide, wide + 1):
                to = np.minimum(np.searchsorted(key, key + step), key.size - 1)
                links.append((np.flatnonzero(key[to] == key + step), to[key[to] == key + step]))
            root = _joined(key.size, *(np.concatenate(x) for x in zip(*links, strict=True)))
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            lists = {"cells": cell, "roots": cell[root]}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "cells"} | {
                c: pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for c, v in lists.items()})


def _parts(mask: DataFrame, by: list[str], max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Pixels with the first pixel (`node`) of the part that holds them within their tile, and (by, node, root):
    the first pixel of the component for the parts that touch others.
    """
    cell = (F.pmod("row", F.lit(TILE)) * TILE + F.pmod("col", F.lit(TILE))).cast("int")
    kinds = {c: mask.schema[c].dataType for c in (*by, *PIXEL)}
    tiles = mask.dropna(subset=[*by, *PIXEL]).groupBy(
        *by, F.floor(F.col("row") / TILE).alias("_tr"), F.floor(F.col("col") / TILE).alias("_tc")).agg(F.collect_set(cell).alias("cells"))
    fields = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in by)
    tiles = pinned(tiles.mapInArrow(_tile_parts, f"{fields}, _tr bigint, _tc bigint, cells array<int>, roots array<int>"))

    def spot(x: str) -> list[Column]:
        return [(F.col("_tr") * TILE + F.floor(F.col(x) / TILE)).cast(kinds["row"]).alias("row"), (F.col("_tc") * TILE + F.col(x) % TILE).cast(kinds["col"]).alias("col")]

    px = tiles.select(*by, "_tr", "_tc", F.inline(F.arrays_zip("cells", "roots")))
    px = px.select(*by, "_tr", "_tc", "cells", *spot("cells"), F.struct(*spot("roots")).alias("node"))
    edge = [F.lit(0), F.lit(TILE - 1)]
    rim = px.where(F.floor(F.col("cells") / TILE).isin(*edge) | (F.col("cells") % TILE).isin(*edge))
    near = F.array(*[F.struct((F.col("row") + r).cast(kinds["row"]).alias("row"), (F.col("col") + c).cast(kinds["col"]).alias("col")) for r, c in ((-1, -1), (-1, 0), (-1, 1), (0, -1))])
    away = F.filter(near, lambda p: (F.floor(p["row"] / TILE) != F.col("_tr")) | (F.floor(p["col"] / TILE) != F.col("_tc")))
    asked = rim.select(*by, F.col("node").alias("u"), F.explode(away).alias("p")).select(*by, "u", "p.row", "p.col")
    edges = asked.join(rim.select(*by, *PIXEL, F.col("node").alias("v")), [*by, *PIXEL]).select(*by, "u", "v")
    edges = pinned(_forward(edges, by))
    seen = _digest(edges)
    for _ in range(max_rounds):
        edges, before = pinned(_small_star(_large_star(edges, by), by)), seen
        seen = _digest(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return px.select(*by, *PIXEL, "node"), edges.groupBy(*by, F.col("u").alias("node")).agg(F.min("v").alias("root"))


def components(mask: DataFrame, by: Sequence[str] = ("record", "label"), max_rounds: int = 60) -> DataFrame:
    """Pixels with their connected component (neighbours in all eight directions) in each mask, named by its first pixel.

    A mask is cut into square tiles, each joined up by itself in arrays; what touches across the
    tiles' rims becomes an edge between parts, and the smallest name spreads by alternating star contractions, which
    needs a number of rounds that grows with the logarithm of the parts of a component. Each round is
    written out, so the plan stays short and survives lost executors.
    """
    by = list(by)
    px, roots = _parts(mask, by, max_rounds)
    named = px.join(roots, [*by, "node"], "left")
    return named.select(*by, *PIXEL, F.coalesce("root", "node").alias("component"))


def _digest(edges: DataFrame) -> tuple:
    """Number of the edges and two sums over 64-bit hashes of them: equal for equal sets, in whatever order."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *edges.columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())


def _forward(edges: DataFrame, by: list[str]) -> DataFrame:
    """Undirected edges as (larger, smaller) without loops."""
    return edges.filter(F.col("u") != F.col("v")).select(
        *by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame, by: list[str]) -> DataFrame:
    both = edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.filter(F.col("v") > F.col("u")).join(low, [*by, "u"])
    return _forward(out.select(*by, F.col("v").alias("u"), F.col("m").alias("v")), by)


def _small_star(edges: DataFrame, by: list[str]) -> DataFrame:
    low = edges.groupBy(*by, "u").agg(F.min("v").alias("m"))
    kids = edges.join(low, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    return _forward(kids.unionByName(low.select(*by, "u", F.col("m").alias("v"))), by)


def largest_component(mask: DataFrame, by: Sequence[str] = ("record", "label")) -> DataFrame:
    """Pixels of the largest component of each mask; the first component wins a tie."""
    by = list(by)
    px, roots = _parts(mask, by, 60)
    parts = px.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("n")).join(roots, [*by, "node"], "left")
    parts = pinned(parts.select(*by, "node", "n", F.coalesce("root", "node").alias("component")))
    sizes = parts.groupBy(*by, "component").agg(F.sum("n").alias("n"))
    best = sizes.groupBy(*by).agg(F.max("n").alias("n")).join(sizes, [*by, "n"]).groupBy(*by).agg(F.min("component").alias("component"))
    kept = parts.join(best, [*by, "component"]).select(*by, "node")
    return px.join(kept, [*by, "node"]).select(*by, *PIXEL)


def intensity_fingerprint(values: DataFrame, channel: str, value: str) -> DataFrame:
    """Mean, median, deviation, range and outer percentiles of a channel, over every value."""
    kept = values.filter(finite(value)).withColumn(value, F.col(value).cast("double"))
    plain = kept.groupBy(channel).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(kept, [channel], {"v": value}, {"median": 0.5, "p005": 0.005, "p995": 0.995})
    return plain.join(q, channel).withColumnsRenamed(
        {"v_median": "median", "v_p005": "percentile_00_5", "v_p995": "percentile_99_5"})


def normalise(values: DataFrame, keys: Sequence[str], value: str, scheme: str,
              fingerprint: DataFrame | None = None, channel: str = "channel") -> DataFrame:
    """Intensity normalisation of one image (`keys`): zscore, clip, range, rgb or none."""
    v = F.col(value).cast("double")
    floor = F.lit(1e-8)
    if scheme == "none":
        return values.withColumn("normalised", v)
    if scheme == "rgb":
        return values.withColumn("normalised", v / 255.0)
    if scheme == "clip":
        if fingerprint is None:
            raise ValueError("clip needs the fingerprint of the data set")
        f = fingerprint.select(channel, "percentile_00_5", "percentile_99_5", "mean", "std")
        joined = values.join(f, channel)
        cut = F.least(F.greatest(v, F.col("percentile_00_5")), F.col("percentile_99_5"))
        return joined.withColumn("normalised", (cut - F.col("mean")) / F.greatest("std", floor)).drop(*f.columns[1:])
    stats = values.groupBy(*keys).agg(
        F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"), F.min(v).alias("_min"), F.max(v).alias("_max"),
        F.count(F.lit(1)).alias("_rows"))
    joined = attach(values, stats, keys)
    if scheme == "zscore":
        out = (v - F.col("_mean")) / F.greatest("_std", floor)
    elif scheme == "range":
        out = (v - F.col("_min")) / F.greatest(F.col("_max") - F.col("_min"), floor)
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    return joined.withColumn("normalised", out).drop("_mean", "_std", "_min", "_max")


def merge_tiles(tiles: DataFrame, place: Sequence[str], label: str, score: str, weight: str) -> DataFrame:
    """Weighted mean of overlapping predictions per (place, label)."""
    w = F.col(weight)
    return tiles.groupBy(*place, label).agg(ratio(F.sum(F.col(score) * w), F.sum(w)).alias(score))


def soft_confusion(cells: DataFrame, keys: Sequence[str], probability: str, truth: str) -> DataFrame:
    """TP / FP / FN / TN as sums of probabilities, and the Dice they give."""
    p, y = F.col(probability), F.col(truth).cast("double")
    out = cells.groupBy(*keys).agg(F.sum(p * y).alias("tp"), F.sum(p * (1 - y)).alias("fp"),
                                   F.sum((1 - p) * y).alias("fn"), F.sum((1 - p) * (1 - y)).alias("tn"))
    return out.withColumn("dice", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
