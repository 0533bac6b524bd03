"""Lines that outliers cannot move, and change points of profiles, by grouped passes of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_totals

# Passes of trimming, its width in robust sigmas, and the least sigma in pixels.
PASSES, TRIM, LEAST_SIGMA = 3, 3.0, 0.5
PIECE = 2048  # keys whose lines are fitted at once


def trimmed_line(points: DataFrame, keys: Sequence[str], x: str, y: str, passes: int = PASSES) -> DataFrame:
    """(keys, nx, ny, off, rms, n, n_kept): total least squares line, trimmed at three robust sigmas in each pass.

    Every pass starts from all points with the line of those kept before. The normal has ny > 0, or nx < 0 where
    the line is vertical. A key with fewer than two different points has no line. The points of a key are held as one array,
    so they meet in one shuffle; the keys of a batch go through the passes together.
    """
    keys = list(keys)
    rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("NOT isnan(_x) AND NOT isnan(_y)")
    rows = rows.dropna(subset=["_x", "_y", *keys])
    each = rows.groupBy(*keys).agg(F.collect_list(F.struct("_x", "_y")).alias("p")).select(*keys, F.col("p._x").alias("_x"), F.col("p._y").alias("_y"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                size = np.diff(batch.column("_x").offsets.to_numpy())
                with np.errstate(all="ignore"):  # infinite distances
                    told = _trimmed(*(batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_x", "_y")), size, passes)
                kept = pa.array(np.flatnonzero(told.pop("found")))
                yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in keys} | {k: pa.array(v) for k, v in told.items()}).take(kept)

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    return each.mapInArrow(kernel, f"{kinds}, nx double, ny double, off double, rms double, n_kept bigint, n bigint")


def _total_least_squares(x: np.ndarray, y: np.ndarray, kept: np.ndarray, first: np.ndarray, key: np.ndarray) -> tuple:
    """Unit normal and offset per key of the line with the least squared distances; nx * x + ny * y + off = 0."""
    n = np.add.reduceat(kept.astype(float), first)

    def mean(v: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.where(kept, v, 0.0), first) / n

    mx, my = mean(x), mean(y)
    dx, dy = x - mx[key], y - my[key]
    # the normal is the direction of least variance: a quarter turn from the main axis
    turn = 0.5 * np.arctan2(2 * mean(dx * dy), mean(dx * dx) - mean(dy * dy))
    nx, ny = -np.sin(turn), np.cos(turn)
    return nx, ny, -(nx * mx + ny * my)


def _medians(v: np.ndarray, used: np.ndarray, key: np.ndarray, n_keys: int) -> np.ndarray:
    """Median of the used values of each key, NaN where there is none."""
    v, key = v[used], key[used]
    v = v[np.lexsort((v, key))]
    n = np.bincount(key, minlength=n_keys)
    start, out = np.cumsum(n) - n, np.full(n_keys, np.nan)
    some = n > 0
    out[some] = (v[(start + (n - 1) // 2)[some]] + v[(start + n // 2)[some]]) / 2
    return out


def _trimmed(x: np.ndarray, y: np.ndarray, size: np.ndarray, passes: int) -> dict[str, np.ndarray]:
    """Lines of many keys at once, whose points lie one key after the other, `size` of them each; infinite distances have
    no part in the medians. `found` says which keys have a line.
    """
    first, key = np.cumsum(size) - size, np.repeat(np.arange(size.size), size)
    found = np.logical_or.reduceat((x != x[first][key]) | (y != y[first][key]), first)
    kept = np.ones(x.size, dtype=bool)
    for _ in range(passes):
        nx, ny, off = _total_least_squares(x, y, kept, first, key)
        r = nx[key] * x + ny[key] * y + off[key]
        before = kept & np.isfinite(r)
        middle = _medians(r, before, key, size.size)
        found &= ~np.isnan(middle)
        away = np.abs(r - middle[key])
        limit = TRIM * np.maximum(1.4826 * _medians(away, before, key, size.size), LEAST_SIGMA)
        kept = away <= limit[key]
    nx, ny, off = _total_least_squares(x, y, kept, first, key)
    n = np.add.reduceat(kept.astype(np.int64), first)
    rest = np.where(kept, nx[key] * x + ny[key] * y + off[key], 0.0)
    return {"nx": nx, "ny": ny, "off": off, "rms": np.sqrt(np.add.reduceat(rest * rest, first) / n), "n_kept": n, "n": size.astype(np.int64), "found": found}


def consensus_line(points: DataFrame, keys: Sequence[str], point: str, x: str, y: str, tolerance: float) -> DataFrame:
    """(keys, slope, intercept, n_agree, n): least squares through the points that agree with the best pair of points.

    A key has a few dozen points (one per band of a page's edge), held as one array; every pair of different x is a
    candidate, all of them within that array. The best has the most points within `tolerance` of it (distance), then the
    least sum of their distances, then the first pair in the order of `point`.
    """
    keys = list(keys)
    each = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(point).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    each = each.select(*keys, F.col("p.x").alias("_x"), F.col("p.y").alias("_y"))

    def kernel(batches):
        for batch in batches:
            found = [_consensus(np.array(px, dtype=float), np.array(py, dtype=float), tolerance) for px, py in zip(batch["_x"], batch["_y"], strict=True)]
            kept = np.array([f is not None for f in found], dtype=bool)
            told = pd.DataFrame([f for f in found if f is not None], columns=["slope", "intercept", "n_agree", "n"])
            yield pd.concat([batch.loc[kept, keys].reset_index(drop=True), told], axis=1)

    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    return each.mapInPandas(kernel, f"{kinds}, slope double, intercept double, n_agree bigint, n int")


def _consensus(x: np.ndarray, y: np.ndarray, tolerance: float) -> tuple | None:
    """(slope, intercept, n_agree, n) of one key, pairs of one first point at a time; sums of distances are compared to nine digits."""
    best = None
    for i in range(x.size - 1):
        others = i + 1 + np.flatnonzero(np.abs(x[i + 1:] - x[i]) >= 1e-9)
        if not others.size:
            continue
        m = (y[others] - y[i]) / (x[others] - x[i])
        c = y[i] - m * x[i]
        far = np.abs(y[None, :] - (m[:, None] * x[None, :] + c[:, None])) / np.sqrt(1 + m * m)[:, None]
        near = far <= tolerance
        agree, off = near.sum(axis=1), np.round(np.where(near, far, 0.0).sum(axis=1), 9)
        k = np.lexsort((off, -agree))[0]  # stable: the first of equals
        if best is None or (agree[k], -off[k]) > best[:2]:
            best = agree[k], -off[k], near[k]
    if best is None or not best[0]:
        return None
    px, py = x[best[2]], y[best[2]]
    spread = ((px - px.mean()) ** 2).sum()
    slope = ((px - px.mean()) * (py - py.mean())).sum() / spread if spread > 0 else None
    return slope, None if slope is None else py.mean() - slope * px.mean(), int(best[0]), x.size


def best_split(profiles: DataFrame, keys: Sequence[str], at: str, features: Sequence[str], low: Column, high: Column) -> DataFrame:
    """(keys, split, sse, sse_whole): the split of a profile with the least squared deviation from the means of its two parts.

    `split` is the number of positions before it, within [low, high], which are columns of the profile's key; the
    first of equals wins. Sums and squares run along the profile in segments, whatever its length.
    """
    keys = list(keys)
    rows = profiles.select(*keys, at, *features, low.alias("_low"), high.alias("_high"))
    sums = {f"_s{i}": F.col(f).cast("double") for i, f in enumerate(features)}
    square = sum((F.col(f).cast("double") * F.col(f) for f in features[1:]), F.col(features[0]).cast("double") * F.col(features[0]))
    ladder = running_totals(rows, keys, [at], {**sums, "_q": square, "_c": F.lit(1).cast("bigint")})
    n, total = F.col("_c"), F.col("_c_total")

    def apart(square_sum: Column, parts: list[Column], count: Column) -> Column:
        return square_sum - sum((p * p / count for p in parts[1:]), parts[0] * parts[0] / count)

    left = apart(F.col("_q"), [F.col(f"_s{i}") for i in range(len(features))], n)
    right = apart(F.col("_q_total") - F.col("_q"), [F.col(f"_s{i}_total") - F.col(f"_s{i}") for i in range(len(features))], total - n)
    whole = apart(F.col("_q_total"), [F.col(f"_s{i}_total") for i in range(len(features))], total)
    tries = ladder.where((n < total) & (n >= F.col("_low")) & (n <= F.col("_high")))
    best = F.min(F.struct((left + right).alias("sse"), n.alias("split"), whole.alias("whole")))
    return tries.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.split").alias("split"), F.col("b.sse").alias("sse"), F.col("b.whole").alias("sse_whole"))


def step_position(profiles: DataFrame, keys: Sequence[str], at: str, features: Sequence[str], reach: int) -> DataFrame:
    """(keys, position, step): where the means of `reach` samples on either side of a profile differ most.

    The position lies between samples, refined by a parabola; profiles are short (one search window each).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(at)
    rows = profiles.select(*keys, at, *features, F.row_number().over(w).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    before, after = w.rowsBetween(-reach, -1), w.rowsBetween(0, reach - 1)
    size = sum((F.pow(F.avg(f).over(after) - F.avg(f).over(before), 2) for f in features[1:]), F.pow(F.avg(features[0]).over(after) - F.avg(features[0]).over(before), 2))
    rows = rows.withColumn("_s", F.sqrt(size)).where((F.col("_k") > reach) & (F.col("_k") <= F.col("_n") - reach + 1))
    rows = rows.withColumn("_l", F.lag("_s").over(w)).withColumn("_r", F.lead("_s").over(w))
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col("_s").alias("s"), (-F.col(at)).alias("o"), F.col("_l").alias("l"), F.col("_r").alias("r"))).alias("b"))
    bend = F.col("b.l") - 2 * F.col("b.s") + F.col("b.r")
    moved = F.when(bend < 0, 0.5 * (F.col("b.l") - F.col("b.r")) / bend).otherwise(0.0)
    return best.select(*keys, (-F.col("b.o") + moved - 0.5).alias("position"), F.col("b.s").alias("step"))
