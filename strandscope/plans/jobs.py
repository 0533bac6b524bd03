"""The jobs a user runs: evaluate a folder, compare two runs, read pages from saved masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..operators import agreement, columns, conditions, fidelity, grid, labels, lines, masks, metrics, page_rows, pairing, resampling, rows, signals, strokes
from ..session import pinned
from ..sources import pages as page_files
from ..sources import records


def evaluate_folders(spark: SparkSession, truth: str, predictions: str, placement: str = "auto",
                     max_shift: int = 50) -> DataFrame:
    """Per record and lead metrics of predicted records against the truth.

    A prediction belongs to the truth record of its name, or of the part in front of a '-'.
    Records without a prediction are left out.
    """
    gt, pred = records.read_signals(spark, truth), records.read_signals(spark, predictions)
    matched = pairing.match_by_prefix(records.list_records(spark, truth), records.list_records(spark, predictions).select(
        F.col("record").alias("prediction")), "record", "prediction").select("record", F.col("match").alias("prediction"))
    est = pred.withColumnRenamed("record", "prediction").join(matched, "prediction").drop("prediction")
    ref = gt.join(matched.select("record"), "record", "left_semi")
    out = metrics.evaluate_signals(ref, est, placement=placement, max_shift=max_shift)
    return out.join(matched, "record")


def evaluate_masks(spark: SparkSession, annotations: str, predicted: str, factor: int = 3, tolerance: int = 1) -> DataFrame:
    """Per record and lead overlap of predicted masks with the annotated traces.

    Frames that may not agree are flagged; pages of another size are left out.
    """
    pages = page_files.read_pages(spark, annotations)
    mask, sizes = page_files.read_masks(spark, predicted)
    info = page_files.read_mask_info(spark, predicted).select("record", "rot_angle")
    matched = pairing.match_by_prefix(sizes.select(F.col("record").alias("mask_record")),
                                      pages.select(F.col("record").alias("page")), "mask_record", "page")
    matched = matched.select("mask_record", F.col("match").alias("page"))
    fits = (sizes.withColumnRenamed("record", "mask_record").join(matched, "mask_record")
            .join(pages.select(F.col("record").alias("page"), F.col("height").alias("_h"), F.col("width").alias("_w"),
                               "rotate", "crop"), "page")
            .filter((F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w"))))
    points = page_files.lead_points(pages)
    points = masks.keep_longest(points, "record", "lead", F.col("full_mode_lead"), F.col("length"))
    dense = masks.densify(points, ["record", "lead_order"], "k", factor)
    truth = masks.rasterise(dense, F.col("height"), F.col("width"))
    gt = truth.join(fits.select(F.col("page").alias("record"), "mask_record"), "record").select(
        F.col("mask_record").alias("record"), "row", "col", "label")
    pred = mask.join(fits.select(F.col("mask_record").alias("record")), "record", "left_semi")
    dims_table = dims.lead_table(spark)
    out = masks.dice_per_label(gt, pred, dims_table, tolerance).join(F.broadcast(dims_table.select("label", "lead")), "label")
    frame = fits.select(F.col("mask_record").alias("record"), "rotate", "crop").join(info, "record", "left")
    moved = (F.abs(F.coalesce("rot_angle", F.lit(0.0))) > 0) | (F.coalesce("rotate", F.lit(0.0)) != 0) | (
        F.coalesce("crop", F.lit(0.0)) != 0)
    return out.join(frame.select("record", "rot_angle", moved.alias("frames_may_differ")), "record")


def compare_runs(run_a: DataFrame, run_b: DataFrame, metric: str = "snr_raw", threshold: float = -1.0,
                 n_boot: int = 2000, seed: int = 0) -> dict[str, DataFrame]:
    """Summary, interval of the median change and the leads that got worse."""
    paired = pairing.pair_runs(run_a, run_b, metric)
    return {"summary": pairing.pair_summary(paired), "worse": pairing.worse_rows(paired, threshold),
            "interval": resampling.bootstrap_median(paired, "record", "delta", n_boot, seed)}


def read_pages_from_masks(mask: DataFrame, sizes: DataFrame, ink: DataFrame | None = None, sharpened: bool = True,
                          placement: str = "column", pixels: DataFrame | None = None, row_mapping: bool = True,
                          snap_offset: float = 0.5) -> dict[str, DataFrame]:
    """Signals of whole pages from label masks: boxes, column grid, maps, traces, baseline, offsets, checks.

    `mask` may come from any segmentation model. With the page's `pixels` the grid is moved onto the printed
    lines and, where these are uneven, samples are read along the map of the layout row, else of the page; without
    usable lines the grid of the mask edges stands. The zero line of a page is put where the sums of the
    limb leads vanish. Pages without a grid give no signal and say why in `grid`.
    Each page is read in one row (`pages`), from which the other results are taken when they are asked for. Samples are
    not stored on the way, so of many pages take what is wanted from `pages` in one pass.
    """
    spark = mask.sparkSession
    facts = sizes.select("record", F.col("height").cast("double").alias("height"))
    if ink is None and pixels is None:
        return page_results(page_rows.packed(mask.withColumn("y", F.col("row")), facts), sharpened, placement)
    dims_table = dims.lead_table(spark)
    table = dims_table.select("label", "lead")
    out, maps = {}, None
    if pixels is not None:
        boxes = masks.bounding_boxes(mask, table).filter(F.col("x1").isNotNull()).join(F.broadcast(table), "label")
        heights = sizes.select("record", "height")
        leads = boxes.select("record", "lead", "x1", (F.col("x2") - F.col("x1") + 1).alias("width"))
        fitted = grid.rescued_grid(leads, heights)
        profiles = pinned(lines.band_profiles(pixels))
        moved = lines.refine_grid(profiles, fitted.filter("reason IS NULL"), snap_offset=snap_offset)
        fitted = fitted.join(moved.select("record", F.col("g0").alias("_g"), F.col("pitch").alias("_p")), "record", "left")
        fitted = pinned(fitted.withColumn("g0", F.coalesce("_g", "g0")).withColumn("pitch", F.coalesce("_p", "pitch")).drop("_g", "_p"))
        good = fitted.join(heights, "record").filter("reason IS NULL")
        verdict, knots = columns.column_map(profiles, good.select("record", "g0", "pitch"), mask_edges(leads, good, dims_table), snap_offset)
        verdict = pinned(verdict)
        knots = pinned(knots.join(verdict.filter("reason IS NULL AND NOT dead_band").select("record"), "record", "left_semi"))
        by_row = pinned(rows.row_maps(pixels, profiles, mask, good, knots, dims_table, snap_offset)) if row_mapping else None
        maps = rows.reading_maps(good, dims_table, knots, by_row).groupBy("record").agg(F.collect_list(F.struct("lead", "knots")).alias("maps"))
        out |= {"page_maps": verdict, "row_maps": by_row}
        facts = facts.join(fitted, "record").join(maps, "record", "left")
    if ink is not None:
        facts = facts.join(strokes.applied_shift(strokes.trace_shift(mask, ink, sizes)).select("record", "applied"), "record", "left")
    pages = pinned(page_rows.packed(strokes.column_centres(mask, ink), facts))
    return out | page_results(pages, sharpened, placement)


def page_results(pages: DataFrame, sharpened: bool = True, placement: str = "column") -> dict[str, DataFrame]:
    """Results of pages that hold their cells in one row each (`page_rows.packed`); `pages` has them all, a page a row."""
    read = page_rows.page_readings(pages, sharpened, placement)
    read = grid.consistency_warning(read.withColumn("warning", F.lit(None).cast("string")))
    sampled = F.exists("mv", lambda v: F.size(v) > 0)
    measures = [f"{name}_{m}" for name in page_rows.RULES for m in page_rows.MEASURES]
    return {"pages": read, "grid": read.select("record", *page_rows.FITTED),
            "signals": page_rows.sample_rows(read, "rescaled").select("record", "lead", "t", "mv", "rescaled"),
            "offsets": page_rows.lead_rows(read).select("record", "lead", "raw", "snapped"),
            "checks": read.where(sampled).select("record", *measures, "warning"),
            "baseline": read.where("reason IS NULL").select("record", "shift", "disagreement")}


def mask_edges(leads: DataFrame, pages: DataFrame, dims_table: DataFrame) -> DataFrame:
    """(record, x, mm): both edges of every lead's mask and the millimetres that the layout gives them.

    A short lead reaches over its own column, a rhythm strip over all of them.
    """
    at = leads.join(pages.select("record", "long_leads"), "record").join(F.broadcast(dims_table.select("lead", "layout_column")), "lead")
    strip = F.array_contains("long_leads", F.col("lead"))
    first, last = F.when(strip, 0).otherwise(F.col("layout_column")), F.when(strip, dims.N_COLUMNS).otherwise(F.col("layout_column") + 1)
    edge = F.array(F.struct(F.col("x1").cast("double").alias("x"), (first * dims.MM_PER_COLUMN).alias("mm")),
                   F.struct((F.col("x1") + F.col("width")).cast("double").alias("x"), (last * dims.MM_PER_COLUMN).alias("mm")))
    return at.select("record", F.inline(edge))


def on_zero_line(read: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples moved by the reading error that the sums of the limb leads show, and that error per page.

    Leads are compared where the layout prints them: each keeps the time of its column.
    """
    mv_per_px = 25 * dims.COLUMN_SECONDS / F.col("pitch") / 10
    start = F.create_map(*[F.lit(x) for k, c in dims.COLUMN.items() for x in (k, int(c * dims.COLUMN_SECONDS * dims.RATE))])
    strips = pages.select("record", "long_leads")
    timed = read.join(strips, "record").withColumn("t", F.col("t") + F.when(F.array_contains("long_leads", F.col("lead")), 0).otherwise(start[F.col("lead")]))
    error = pinned(grid.baseline_shift(timed.select("record", "lead", "t", "mv"), pages.select("record", "pitch"), mv_per_px,
                                       int(dims.COLUMN_SECONDS * dims.RATE)))
    by = error.join(pages.select("record", "pitch"), "record").select("record", (F.col("shift") * mv_per_px).alias("_up"))
    return read.join(by, "record", "left").withColumn("mv", F.col("mv") + F.coalesce("_up", F.lit(0.0))).drop("_up"), error


def fidelity_table(logits: DataFrame, snr: DataFrame | None = None) -> dict[str, DataFrame]:
    """Agreement of two systems' decisions: overall, per class, per record, ranking quality."""
    decided = agreement.with_decisions(logits)
    per_record = agreement.record_flips(decided)
    if snr is not None:
        per_record = per_record.join(snr, "record", "left")
    ranking = agreement.auroc_retention(logits)
    return {"overall": agreement.decision_summary(decided), "per_class": agreement.decision_summary(decided, ["class"]),
            "records": per_record, "flip_rate": agreement.record_flip_rate(per_record),
            "margins": agreement.margin_summary(per_record), "ranking": ranking,
            "macro": agreement.macro_retention(ranking)}


def condition_job(name: str, truth: DataFrame, original: DataFrame, reading: DataFrame, score: Callable[[DataFrame], DataFrame], thresholds: DataFrame,
                  classes: Sequence[str], labels: DataFrame | None = None, evaluation: DataFrame | None = None, fs: float = 500.0,
                  fs_out: float = 100, n_out: int = 1000) -> dict[str, DataFrame]:
    """Fidelity of one condition from its three sets of samples (record, lead, t, mv): checks, scores, SNR, one row of figures.

    `score` maps prepared signals (record, lead, kind, t, y, in_span) to (record, kind, class, z); kinds are the original
    inside the printed windows (`masked`) and the reading there (`read`). `thresholds` has (class, thr, thr_full),
    `labels` (record, class, y), `evaluation` (record, snr_raw, missing). Records that cannot be used are in `checked`
    with their reason and nowhere else; a record without a reading is scored as zeros.
    """
    keys = ["record", "lead", "t"]
    checked = pinned(conditions.reconciled(truth, original, reading))
    usable = checked.filter("reason IS NULL").select("record")
    grid_rows = original.select(*keys).join(usable, "record", "left_semi")
    inputs = conditions.masked_inputs(truth, original, reading, checked, ("masked", "read"))
    whole = grid_rows.withColumn("kind", F.explode(F.array(F.lit("masked"), F.lit("read")))).join(inputs, [*keys, "kind"], "left")
    prepared = pinned(signals.prepare(whole, ["record", "lead", "kind"], fs, fs_out, n_out))
    z = score(prepared).groupBy("record", "class").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("z"))).alias(f"z_{system}") for kind, system in (("masked", "ref"), ("read", "test"))])
    logits = z.join(thresholds.select("class", "thr", "thr_full"), "class").withColumn("condition", F.lit(name))
    if labels is None:
        logits = pinned(logits.withColumn("y", F.lit(None).cast("int")))
    else:
        logits = pinned(logits.join(labels.select("record", "class", "y"), ["record", "class"], "left"))
    losses = fidelity.window_losses(truth.join(usable, "record", "left_semi"), reading, ["record", "lead"])
    if evaluation is not None:
        evaluation = evaluation.join(usable, "record", "left_semi").withColumn("condition", F.lit(name))
    row = fidelity.condition_table(logits, classes, losses.withColumn("condition", F.lit(name)), evaluation)
    return {"checked": checked, "logits": logits, "losses": losses, "snr": fidelity.snr_of_prepared(prepared), "table": row}


def cached_scores(inputs: DataFrame, cache: DataFrame, score, key: str = "key", digest: str = "sha1") -> tuple[DataFrame, DataFrame]:
    """Scores of prepared inputs, computed only where the input is new or has changed.

    `score` maps a DataFrame of inputs to one of (key, digest, ...scores); returns the
    scores of all inputs and the cache to store.
    """
    _, misses = labels.cached(inputs, cache, key, digest)
    stored = labels.refreshed(cache, score(misses), key)
    return inputs.select(key, digest).join(stored, [key, digest]), stored
