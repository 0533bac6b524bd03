"""Ordered operators on sample grids: runs, gaps, filters along a run, running medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import by_grid, grid_numbered, neighbourhood, numbered, running_totals, value_neighbourhood
from .quantiles import exact_quantiles


def column_runs(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Maximal runs of consecutive integers: `run_start`, `run_end` (half open) and `run`."""
    runs = grid_numbered(df.select(*keys, x).distinct(), keys, x)
    return (runs.groupBy(*keys, (F.col(x) - F.col("rn")).alias("_island"))
            .agg(F.min(x).alias("run_start"), (F.max(x) + 1).alias("run_end"), F.count(F.lit(1)).alias("run_length"))
            .drop("_island"))


def with_runs(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Rows of a one-row-per-position series with their row number and a run number."""
    return grid_numbered(df, keys, x).withColumn("run", F.col(x) - F.col("rn"))


def max_gap(df: DataFrame, keys: Sequence[str], x: str, window: tuple[Column, Column] | None = None) -> DataFrame:
    """Longest stretch of empty positions between filled ones, optionally clipped to a window.

    Keys with fewer than two filled positions have a gap of 0.
    """
    rows = grid_numbered(df, keys, x)
    rows = neighbourhood(rows, keys, "rn", 1, lambda w: {"_next": F.lead(x).over(w)})
    if window is None:
        empty = F.col("_next") - F.col(x) - 1
    else:
        empty = F.least(F.col("_next"), window[1]) - F.greatest(F.col(x) + 1, window[0])
    return rows.groupBy(*keys).agg(F.greatest(F.coalesce(F.max(empty), F.lit(0)), F.lit(0)).alias("max_gap"))


def overhang(df: DataFrame, keys: Sequence[str], x: str, window: tuple[Column, Column]) -> DataFrame:
    """Largest distance of a filled position's centre beyond the window (0 inside)."""
    return df.groupBy(*keys).agg(F.greatest(
        window[0] - (F.min(x) + F.lit(0.5)), (F.max(x) + F.lit(0.5)) - window[1], F.lit(0.0)).alias("overhang"))


def unwrap(df: DataFrame, keys: Sequence[str], x: str, value: str, period: float, name: str = "unwrapped",
           grid: int = 65536) -> DataFrame:
    """Continue a periodic reading: each step is taken the short way round, in [-p/2, p/2).

    The unwrapped value is the first one plus the running sum of the wrapped steps.
    """
    rows = grid_numbered(df, keys, x)
    rows = neighbourhood(rows, keys, "rn", 1, lambda w: {"_before": F.lag(value).over(w)})
    step = F.col(value) - F.col("_before")
    wrapped = F.pmod(step + F.lit(period / 2.0), F.lit(float(period))) - F.lit(period / 2.0)
    rows = rows.withColumn("_step", F.when(F.col("_before").isNull(), F.col(value)).otherwise(wrapped))
    rows = rows.drop("_before", "rn", "rn_total")
    return running_totals(by_grid(rows, x, grid), keys, [x], {name: "_step"}, segmented=True).drop(
        "_step", f"{name}_total")


def aperture_filter(df: DataFrame, keys: Sequence[str], x: str, value: str, a: float = 0.125,
                    name: str = "filtered") -> DataFrame:
    """p - a (left - 2 p + right) along each run; the ends of a run repeat their own value."""
    rows = with_runs(df, keys, x)
    rows = neighbourhood(rows, keys, "rn", 1, lambda w: {
        "_l": F.lag(F.struct(value, "run")).over(w), "_r": F.lead(F.struct(value, "run")).over(w)})
    p = F.col(value)
    left = F.when(F.col("_l.run") == F.col("run"), F.col(f"_l.{value}")).otherwise(p)
    right = F.when(F.col("_r.run") == F.col("run"), F.col(f"_r.{value}")).otherwise(p)
    return rows.withColumn(name, p - F.lit(a) * (left - 2.0 * p + right)).drop("_l", "_r", "rn", "rn_total", "run")


def neighbour_spikes(df: DataFrame, keys: Sequence[str], x: str, value: str, tolerance: float) -> DataFrame:
    """Flag values further than `tolerance` from the median of their four neighbours.

    The ends are padded with the edge value; series shorter than five rows have no spikes.
    """
    rows = grid_numbered(df, keys, x)

    def around(w):
        v = F.col(value)
        l1, r1 = F.lag(v, 1).over(w), F.lead(v, 1).over(w)
        l2, r2 = F.lag(v, 2).over(w), F.lead(v, 2).over(w)
        return {"_n": F.sort_array(F.array(
            F.coalesce(l1, v), F.coalesce(r1, v), F.coalesce(l2, l1, v), F.coalesce(r2, r1, v)))}

    rows = neighbourhood(rows, keys, "rn", 2, around)
    middle = (F.col("_n")[1] + F.col("_n")[2]) / 2.0
    return rows.withColumn("neighbour_median", middle).withColumn(
        "spike", (F.col("rn_total") >= 5) & (F.abs(F.col(value) - middle) > F.lit(tolerance))
    ).drop("_n", "rn", "rn_total")


def jump_runs(df: DataFrame, keys: Sequence[str], x: str, value: str, threshold: float,
              min_length: int = 1, grid: int = 65536) -> DataFrame:
    """Split a series where neighbouring values jump by more than `threshold`; keep long runs.

    Adds `run` (0-based) and `run_length`; rows of runs below `min_length` are dropped.
    """
    rows = grid_numbered(df, keys, x)
    rows = neighbourhood(rows, keys, "rn", 1, lambda w: {"_before": F.lag(value).over(w)})
    cut = F.coalesce((F.abs(F.col(value) - F.col("_before")) > threshold).cast("int"), F.lit(0))
    rows = rows.withColumn("_cut", cut).drop("_before", "rn", "rn_total")
    rows = running_totals(by_grid(rows, x, grid), keys, [x], {"run": "_cut"}, segmented=True).drop("_cut", "run_total")
    lengths = rows.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("run_length"))
    return rows.join(lengths.filter(F.col("run_length") >= min_length), [*keys, "run"])


def running_median(df: DataFrame, keys: Sequence[str], m: str, value: str, width: float,
                   name: str = "smoothed") -> DataFrame:
    """Median of the values within +-width/2 around each knot, edge values carried outwards.

    The carried knots lie at the median knot spacing, as many as the half width needs.
    """
    half = width / 2.0
    rows = df.select(*keys, F.col(m).cast("double").alias(m), F.col(value).cast("double").alias(value))
    counted = numbered(rows, keys, [m])
    steps = neighbourhood(counted, keys, "rn", 1, lambda w: {"_d": F.col(m) - F.lag(m).over(w)})
    spacing = exact_quantiles(steps, keys, {"_spacing": "_d"})
    ends = rows.groupBy(*keys).agg(
        F.min(m).alias("_m0"), F.max(m).alias("_m1"),
        F.min_by(value, m).alias("_v0"), F.max_by(value, m).alias("_v1")).join(spacing, list(keys), "left")
    gap = F.coalesce("_spacing_median", F.lit(half))
    pads = ends.select(*keys, "_m0", "_m1", "_v0", "_v1", gap.alias("_gap"),
                       F.explode(F.sequence(F.lit(1), (F.ceil(half / gap) + 1).cast("int"))).alias("_i"))
    before = pads.select(*keys, (F.col("_m0") - F.col("_gap") * F.col("_i")).alias(m), F.col("_v0").alias(value))
    after = pads.select(*keys, (F.col("_m1") + F.col("_gap") * F.col("_i")).alias(m), F.col("_v1").alias(value))
    every = (rows.withColumn("_pad", F.lit(False))
             .unionByName(before.unionByName(after).withColumn("_pad", F.lit(True))))
    out = value_neighbourhood(every, keys, m, half, lambda over: {name: f"percentile(`{value}`, 0.5D) {over}"})
    return out.filter(~F.col("_pad")).drop("_pad")


def sliding_max(df: DataFrame, keys: Sequence[str], t: str, value: str, length: int, stride: int,
                total: int | Column) -> DataFrame:
    """Largest value of each window [start, start + length) inside [0, total), with starts every `stride` samples."""
    last = F.lit(total) - length
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - length + 1) / F.lit(stride)) * stride)
    final = F.least(last - last % stride, F.floor(F.col(t) / F.lit(stride)) * stride)
    starts = F.when(first <= final, F.sequence(first, final, F.lit(stride).cast("bigint")))
    return (df.filter((F.col(t) >= 0) & (F.col(t) < total)).withColumn("window_start", F.explode(starts))
            .groupBy(*keys, "window_start").agg(F.max(value).alias("window_max"), F.count(value).alias("n")))


def zone_statistics(df: DataFrame, keys: Sequence[str], t: str, diff: str, n: Column, edge: int) -> DataFrame:
    """Largest, median and 99th percentile of |difference| at the head, the tail and between."""
    zone = (F.when(F.col(t) < edge, "head").when(F.col(t) >= n - edge, "tail").otherwise("interior"))
    rows = df.select(*keys, zone.alias("zone"), F.abs(diff).alias("d"))
    top = rows.groupBy(*keys, "zone").agg(F.max("d").alias("d_max"), F.count("d").alias("n"))
    mid = exact_quantiles(rows, [*keys, "zone"], {"d": "d"}, {"median": 0.5, "p99": 0.99})
    return top.join(mid, [*keys, "zone"])


def window_gaps(df: DataFrame, keys: Sequence[str], value: str, in_window: Column) -> DataFrame:
    """Window samples, missing ones, their share, and whether nothing was read in the window."""
    from ..functions.numbers import finite, ratio

    inside = F.coalesce(in_window, F.lit(False))
    out = df.groupBy(*keys).agg(
        F.sum(inside.cast("int")).alias("n_window"),
        F.sum((inside & ~finite(value)).cast("int")).alias("n_nan"))
    return out.withColumn("nan_frac", ratio("n_nan", "n_window")).withColumn(
        "missing", (F.col("n_window") > 0) & (F.col("n_nan") == F.col("n_window")))
