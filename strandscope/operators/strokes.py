"""Reading a trace off its pixels: column centres weighted by ink, and the page shift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .quantiles import exact_quantiles

MIN_CONTRAST, POWER = 0.75, 4
SHIFT_MIN_RUN, SHIFT_CORNER, SHIFT_PAD, SHIFT_PEAK, SHIFT_POWER, SHIFT_MIN_ROWS = 6, 2, 2, 0.5, 2, 30
SHIFT_INK_SHARE, SHIFT_DEAD_BAND = 0.67, 0.05
BY = ["record", "label"]


def inked(mask: DataFrame, ink: DataFrame) -> DataFrame:
    """The pixels of the mask with the `ink` under them (no ink counts as 0). A mask that brings its own is left as it is."""
    if "ink" in mask.columns:
        return mask
    return mask.join(ink, ["record", "row", "col"], "left").withColumn("ink", F.coalesce("ink", F.lit(0.0)))


def ink_level(mask: DataFrame, ink: DataFrame) -> DataFrame:
    """95th percentile of the ink under each lead's mask (no ink counts as 0)."""
    values = inked(mask, ink).groupBy(*BY, "ink").agg(F.count(F.lit(1)).alias("_c"))
    return _level_of(values)


def _level_of(values: DataFrame) -> DataFrame:
    """`ink_level` from how often (`_c`) each value of the ink occurs under a lead's mask."""
    counts = values.groupBy(*BY).agg(F.sum("_c").alias("_rows"))
    return exact_quantiles(values, BY, {"ink": "ink"}, {"p95": 0.95}, weight="_c").join(counts, BY)


def column_centres(mask: DataFrame, ink: DataFrame | None = None) -> DataFrame:
    """Row of the trace per column: the mean mask row, or its ink-weighted mean.

    A lead whose stroke is too pale keeps the plain mean everywhere, a column without
    any ink keeps it for itself. The weights of a column are sums of powers of the ink, over one power of the
    lead's level: the level is not needed before the pixels are added up.
    """
    plain = F.avg("row").alias("y_mask")
    if ink is None:
        return mask.groupBy(*BY, "col").agg(plain).withColumn("y", F.col("y_mask"))
    px = inked(mask, ink)
    weight = F.pow(F.col("ink") / 255, POWER)
    values = px.groupBy(*BY, "ink").agg(F.count(F.lit(1)).alias("_c"))
    heavy = px.groupBy(*BY, "col").agg(plain, F.sum(weight).alias("_w"), F.sum(weight * F.col("row")).alias("_wr"))
    heavy = heavy.join(_level_of(values).drop("_rows"), BY)
    usable = F.coalesce((F.col("ink_p95") >= MIN_CONTRAST * 255) & (F.col("_w") > 0), F.lit(False))
    return heavy.select(*BY, "col", "y_mask", F.when(usable, F.col("_wr") / F.when(F.col("_w") > 0, F.col("_w")))
                        .otherwise(F.col("y_mask")).alias("y"))


def _run_shifts(mask: DataFrame, ink: DataFrame) -> DataFrame:
    """(record, right, d): how far right of its middle the ink of a steep row run sits, and the last column it looked at.

    `mask` has steep and p95 (of the lead) with every pixel. A row of a page lies in one array, so its runs and windows need no
    join of pixels.
    """
    def cells(df: DataFrame, name: str, *columns: str) -> DataFrame:
        held = F.struct(F.col("col").cast("long").alias("col"), *columns)
        return df.select("record", "row", held.alias(name))

    both = cells(mask, "m", "label", "steep", "p95").unionByName(cells(ink.where("ink <> 0"), "i", "ink"), allowMissingColumns=True)
    lines = both.groupBy("record", "row").agg(F.collect_list("m").alias("m"), F.collect_list("i").alias("i")).where("size(m) > 0")

    def one(col, label, steep, p95, at, ink_at):
        order = np.lexsort((col, label))
        col, label, steep, p95 = col[order], label[order], steep[order], p95[order]
        low = col.min() - SHIFT_PAD
        size = col.max() + SHIFT_PAD - low + 2
        dark, held = np.zeros(size), np.zeros(size)
        near = (at >= low) & (at < low + size - 1)
        dark[at[near] - low] = ink_at[near]
        held[col - low] = 1
        first = np.flatnonzero(np.r_[True, (np.diff(label) != 0) | (np.diff(col) > 1)])
        last = np.r_[first[1:], col.size] - 1
        s, e, p95 = col[first], col[last], p95[first]
        cut = np.stack([s - SHIFT_PAD - low, e + SHIFT_PAD + 1 - low], axis=1).ravel()
        total = lambda f, x: f.reduceat(x, cut)[::2]
        good = (total(np.add, held) == e - s + 1) & (p95 > 0) & (total(np.maximum, dark) >= SHIFT_PEAK * p95) & (s >= SHIFT_PAD)
        good &= np.logical_or.reduceat(steep, first)
        w = dark ** SHIFT_POWER
        heavy, moment = total(np.add, w)[good], total(np.add, w * np.arange(size))[good]
        return e[good] + SHIFT_PAD, low + moment / heavy - 0.5 * (s + e)[good]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, parts = [], []
            for name in ("m", "i"):
                lists = batch.column(name)
                held.append((lists.offsets.to_numpy(), [f.to_numpy(zero_copy_only=False) for f in lists.values.flatten()]))
            (m_at, m), (i_at, i) = held
            for k in range(batch.num_rows):
                parts.append(one(*(c[m_at[k]:m_at[k + 1]] for c in m), *(c[i_at[k]:i_at[k + 1]] for c in i)))
            n = [len(p[0]) for p in parts]
            yield pa.RecordBatch.from_pydict({
                "record": batch.column("record").take(pa.array(np.repeat(np.arange(len(n)), n))),
                "right": pa.array(np.concatenate([p[0] for p in parts]) if parts else [], pa.int64()), "d": pa.array(np.concatenate([p[1] for p in parts]) if parts else [], pa.float64())})

    kind = mask.schema["record"].dataType.simpleString()
    return lines.select("record", "m", "i").mapInArrow(kernel, f"record {kind}, right bigint, d double")


def trace_shift(mask: DataFrame, ink: DataFrame, widths: DataFrame) -> DataFrame:
    """How far right of the mask the ink sits, per page: median over rows of steep strokes.

    `widths` has (record, width) of every page.

    Every row run of a lead that holds a steep pixel is compared with the ink in a window
    of two more pixels on each side. Windows that leave the page, meet other mask
    pixels, or hold no dark ink are left out. Fewer than thirty rows give no shift.
    """
    level = ink_level(mask, ink).drop("_rows")
    columns = mask.groupBy(*BY, "col").agg(
        F.count(F.lit(1)).alias("_n"), F.min("row").alias("_top"), F.max("row").alias("_bottom"))
    steep = (F.col("_n") >= SHIFT_MIN_RUN) & (F.col("row") >= F.col("_top") + SHIFT_CORNER) & (F.col("row") <= F.col("_bottom") - SHIFT_CORNER)
    known = mask.select(*BY, "row", "col").join(columns.join(level, BY), [*BY, "col"])
    known = known.select("record", "row", "col", F.col("label").cast("int").alias("label"), steep.alias("steep"), F.col("ink_p95").alias("p95"))
    seen = _run_shifts(known, ink)
    samples = pinned(seen.join(widths.select("record", "width"), "record").where(F.col("right") < F.col("width")).select("record", "d"))
    mid = exact_quantiles(samples, ["record"], {"d": "d"})
    counts = samples.groupBy("record").agg(F.count(F.lit(1)).alias("n_rows"))
    every = mask.select("record").distinct().join(counts, "record", "left").join(mid, "record", "left")
    n = F.coalesce("n_rows", F.lit(0).cast("bigint"))
    return every.select("record", n.alias("n_rows"), F.col("d_median").alias("median"),
                        F.when(n >= SHIFT_MIN_ROWS, F.col("d_median")).otherwise(0.0).alias("dx"))


def applied_shift(measured: DataFrame, ink_estimator: bool = True) -> DataFrame:
    """The shift as it is used: shared with the ink estimator, small ones dropped."""
    dx = F.col("dx") * (SHIFT_INK_SHARE if ink_estimator else 1.0)
    return measured.withColumn("applied", F.when(F.abs(dx) < SHIFT_DEAD_BAND, 0.0).otherwise(dx))
