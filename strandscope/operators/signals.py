"""Preparing sampled signals: gaps, resampling, noise, scaling, sampling a trace.

One printed strip is at most one page long, so a (record, lead) is one task-sized
array; gaps and resampling have local support and are done in chunks of the time axis
instead, whatever the length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.filters import butterworth, fractional_delay, pad_length, quantised_lag, rate_ratio, resampling_taps, sharpen_all, zero_phase
from ..functions.numbers import finite
from .grid import interpolate

CHUNK = 65536
SIDE_BY_SIDE = 384  # leads that are sampled at once


def _fields(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def fill_gaps(samples: DataFrame, keys: Sequence[str], t: str = "t", value: str = "mv",
              cell: float = 256.0) -> DataFrame:
    """Missing samples between finite ones on a straight line, edge values held outside.

    Adds `filled` and `in_span` (between the first and the last finite sample). Signals
    without a finite sample are 0 throughout.
    """
    keys = list(keys)
    good = samples.filter(finite(value)).select(*keys, F.col(t).cast("double").alias("_m"), F.col(value).alias("_x"))
    span = good.groupBy(*keys).agg(F.min("_m").alias("_first"), F.max("_m").alias("_last"))
    probes = samples.withColumn("_m", F.col(t).cast("double"))
    out = interpolate(probes, good, keys, "_m", "_x", cell, name="filled").join(span, keys, "left")
    inside = F.coalesce((F.col("_m") >= F.col("_first")) & (F.col("_m") <= F.col("_last")), F.lit(False))
    return out.withColumn("filled", F.coalesce("filled", F.lit(0.0))).withColumn("in_span", inside).drop(
        "_m", "_first", "_last")


def resample(samples: DataFrame, keys: Sequence[str], fs_in: float, fs_out: float, t: str = "t",
             value: str = "filled", span: str = "in_span", chunk: int = CHUNK) -> DataFrame:
    """Rational resampling with the line from the first to the last sample carried on outside.

    The filter reaches ten periods of the slower rate, so the time axis is cut into
    chunks that get that many neighbouring samples. Output sample k is in the span when
    input sample k x down // up is; outside the span it is 0.
    """
    keys = list(keys)
    up, down = rate_ratio(fs_in, fs_out)
    rows = samples.select(*keys, F.col(t).cast("bigint").alias("t"), F.col(value).cast("double").alias("x"),
                          F.col(span).alias("s"))
    if up == down:
        return rows.select(*keys, "t", F.when(F.col("s"), F.col("x")).otherwise(0.0).alias("y"), F.col("s").alias("in_span"))
    taps = resampling_taps(up, down)
    half = taps.size // 2
    reach = half // up + 2
    per = up * max(1, chunk // down)  # outputs of a chunk, which start on an input sample
    stride = per // up * down
    ends = rows.groupBy(*keys).agg(F.max("t").alias("_last"), F.min_by("x", "t").alias("_x0"), F.max_by("x", "t").alias("_x1"))
    spots = F.sequence(F.floor((F.col("t") - reach) / stride), F.floor((F.col("t") + reach) / stride))
    placed = rows.withColumn("_c", F.explode(spots)).filter("_c >= 0").join(ends, keys)
    placed = placed.filter(F.col("_c") <= F.floor(F.col("_last") / stride))

    arrays = placed.groupBy(*keys, "_c", "_last", "_x0", "_x1").agg(F.array_sort(F.collect_list(F.struct("t", "x", "s"))).alias("_a"))
    arrays = arrays.select(*keys, "_c", "_last", "_x0", "_x1", *[F.col(f"_a.{name}").alias(f"_{name}") for name in ("t", "x", "s")])

    def one(c, last, x0, x1, t, value, known):
        slope = (x1 - x0) / last if last > 0 else 0.0
        n_out = -(-(last + 1) * up // down)
        k = np.arange(c * per, min((c + 1) * per, n_out))
        if k.size == 0:
            return k, k.astype(float), k.astype(bool)
        low, high = (k[0] * down - half) // up - 1, (k[-1] * down + half) // up + 2
        at = np.arange(low, high + 1)
        x = np.where(at < 0, x0 + at * slope, x1 + (at - last) * slope)
        s = np.zeros(at.size, dtype=bool)
        mine = (t >= low) & (t <= high)
        x[t[mine] - low], s[t[mine] - low] = value[mine], known[mine]
        first = -((half - k * down) // up)  # first input sample the filter sees
        m = first[:, None] + np.arange(2 * half // up + 1)[None, :]
        j = half + k[:, None] * down - m * up
        weight = np.where((j >= 0) & (j < taps.size), taps[np.clip(j, 0, taps.size - 1)], 0.0)
        keep = s[np.minimum(k * down // up, last) - low]
        return k, np.where(keep, (x[m - low] * weight).sum(axis=1), 0.0), keep

    def kernel(batches):
        for batch in batches:
            parts = [one(*row) for row in zip(batch["_c"], batch["_last"], batch["_x0"], batch["_x1"],
                                              batch["_t"], batch["_x"], batch["_s"])]
            times = [len(p[0]) for p in parts]
            head = batch[keys].loc[batch.index.repeat(times)].reset_index(drop=True)
            yield head.assign(t=np.concatenate([p[0] for p in parts]), y=np.concatenate([p[1] for p in parts]),
                              in_span=np.concatenate([p[2] for p in parts]))

    return arrays.mapInPandas(kernel, f"{_fields(samples, keys)}, t bigint, y double, in_span boolean")


def prepare(samples: DataFrame, keys: Sequence[str], fs_in: float, fs_out: float = 100, n_out: int = 1000) -> DataFrame:
    """Gap-free samples at the classifier's rate, cut to `n_out`, in single precision."""
    filled = fill_gaps(samples, keys)
    out = resample(filled, keys, fs_in, fs_out).filter(F.col("t") < n_out)
    return out.withColumn("y", F.col("y").cast("float"))


def in_layout(lead: Column, t: Column, fs: float) -> Column:
    """Whether a sample lies in the printed window of its lead."""
    start = F.create_map(*[F.lit(x) for n in dims.LEADS for x in (
        n, 0 if n == dims.RHYTHM_LEAD else round(dims.COLUMN[n] * dims.COLUMN_SECONDS * fs))])
    end = F.create_map(*[F.lit(x) for n in dims.LEADS for x in (
        n, round((dims.PAGE_SECONDS if n == dims.RHYTHM_LEAD else (dims.COLUMN[n] + 1) * dims.COLUMN_SECONDS) * fs))])
    return F.coalesce((t >= F.try_element_at(start, lead)) & (t < F.try_element_at(end, lead)), F.lit(False))


def _per_signal(samples: DataFrame, keys: list[str], t: str, value: str, extra: list[str], change, schema: str) -> DataFrame:
    """Run `change(array, first row)` on each signal laid out on its sample grid."""
    def kernel(batches):
        for batch in batches:
            parts = []
            for row in batch.to_dict("records"):
                at = np.asarray(row["_t"], dtype=np.int64)
                x = np.full(int(at.max()) + 1, np.nan)
                x[at] = np.asarray(row["_x"], dtype=float)
                parts.append(pd.DataFrame({**{k: row[k] for k in keys}, **change(x, row)}))
            yield pd.concat(parts, ignore_index=True)

    head = list(dict.fromkeys([*keys, *extra]))
    arrays = samples.groupBy(*head).agg(F.array_sort(F.collect_list(F.struct(
        F.col(t).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("x")))).alias("_a"))
    arrays = arrays.select(*head, F.col("_a.t").alias("_t"), F.col("_a.x").alias("_x"))
    return arrays.mapInPandas(kernel, f"{_fields(samples, keys)}, {schema}")


def add_band_noise(samples: DataFrame, record: str, lead_index: str, levels: Sequence[float], seed: int = 0,
                   fs: float = 500.0, band: tuple[float, float] = (0.5, 40.0), order: int = 4,
                   n_leads: int = 12) -> DataFrame:
    """Each signal at each SNR level with band-limited noise of exactly that SNR.

    The noise depends on (seed, record, level, lead) alone, so any task can draw it. The
    stream is that of a whole record (samples x leads), of which a lead takes its column.
    An infinite level is the signal itself. Level numbers follow the order given. A signal shorter than the filter
    takes the start of a stream that is just long enough.
    """
    levels = [float(v) for v in dict.fromkeys(float(v) for v in levels)]
    if any(np.isnan(v) or v == -np.inf for v in levels):
        raise ValueError("SNR levels must be finite or +inf")
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(v).alias("snr_db")) for i, v in enumerate(levels)]))
    long = samples.withColumn("_l", table).select("*", "_l.level", "_l.snr_db").drop("_l")
    sos = butterworth(order, band[0], band[1], fs)
    shortest = pad_length(sos) + 1

    def noisy(x, head):
        level = float(head["snr_db"])
        t = np.arange(x.size)
        if level == np.inf:
            return {"t": t, "mv": x}
        rng = np.random.default_rng([seed, int(head[record]) % 2 ** 64, int(head["level"])])
        white = rng.standard_normal((max(x.size, shortest), n_leads))[:, int(head[lead_index])]
        noise = zero_phase(sos, white)[:x.size]
        here = np.isfinite(x)
        power, loud = np.sum(x[here] ** 2), np.sum(noise[here] ** 2)
        scale = np.sqrt(power / (loud * 10 ** (level / 10))) if loud > 0 else 0.0
        return {"t": t, "mv": x + noise * scale}

    return _per_signal(long, [record, lead_index, "level", "snr_db"], "t", "mv", [], noisy, "t bigint, mv double")


def shift_signals(samples: DataFrame, shift: Column, n: int, t: str = "t") -> DataFrame:
    """Samples moved by whole steps inside [0, n); what is shifted out is lost, gaps stay empty."""
    return samples.withColumn(t, F.col(t) + shift).filter((F.col(t) >= 0) & (F.col(t) < n))


def delay_signals(samples: DataFrame, keys: Sequence[str], delay: str, t: str = "t", value: str = "mv") -> DataFrame:
    """Delay by a fraction of a sample."""
    return _per_signal(samples, list(keys), t, value, [delay],
                       lambda x, head: {"t": np.arange(x.size), "mv": fractional_delay(x, float(head[delay]))},
                       "t bigint, mv double")


def drawn_lag(pairs: DataFrame, keys: Sequence[str], levels: int = 50, t: str = "t") -> DataFrame:
    """Horizontal and vertical offset of an estimate by correlating both drawings."""
    keys = list(keys)

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        at = group[t].to_numpy(dtype=np.int64)
        ref, est = np.full(int(at.max()) + 1, np.nan), np.full(int(at.max()) + 1, np.nan)
        ref[at], est[at] = group["ref"].to_numpy(float), group["est"].to_numpy(float)
        head = {k: [group[k].iloc[0]] for k in keys}
        if not (np.isfinite(ref).any() and np.isfinite(est).any()) or np.nanmax([ref, est]) == np.nanmin([ref, est]):
            return pd.DataFrame({**head, "lag": [None], "offset": [None]})
        lag, offset = quantised_lag(ref, est, levels)
        return pd.DataFrame({**head, "lag": [lag], "offset": [offset]})

    return pairs.select(*keys, t, "ref", "est").groupBy(*keys).applyInPandas(
        kernel, f"{_fields(pairs, keys)}, lag int, offset double")


def sampled(lines: Sequence[tuple], sharpened: bool = True, rate: int = dims.RATE) -> list[np.ndarray]:
    """Samples in mV of leads from their column centres: of each (lead, strip, pitch, g0, height, dx, cols, y, mm, at).

    They are read along the knots (mm, at), or along even columns where a lead has none.
    """
    per, spots = int(dims.COLUMN_SECONDS * rate), []
    for lead, strip, pitch, g0, _, dx, _, _, mm, at in lines:
        n = dims.N_COLUMNS * per if strip else per
        columns = (0 if strip else dims.COLUMN[lead]) + np.arange(n) / per
        if mm is None or not len(mm):
            x = g0 + columns * pitch
        else:
            m, period = columns * dims.MM_PER_COLUMN, pitch / dims.MM_PER_COLUMN
            x = np.interp(m, mm, at) + np.minimum(m - mm[0], 0) * period + np.maximum(m - mm[-1], 0) * period
        spots.append(x - 0.5 - dx)
    traces = [(line[6], line[7], x) for line, x in zip(lines, spots, strict=True)]
    traced = sharpen_all(traces, rate) if sharpened else [np.interp(x, cols, y) for cols, y, x in traces]
    out = []
    for (lead, strip, pitch, _, height, *_), v in zip(lines, traced, strict=True):
        base = (1 - dims.baseline_ratio(lead, strip)) * height
        out.append(((base - (v + 0.5)) * (25 * dims.COLUMN_SECONDS / pitch / 10)).astype(np.float32).astype(float))
    return out


def vectorise(profile: DataFrame, grid: DataFrame, shift: Column | None = None, sharpened: bool = True,
              rate: int = dims.RATE, maps: DataFrame | None = None) -> DataFrame:
    """Samples in mV of each lead from its column centres on the page's column grid.

    `profile` has (record, lead, col, y); `grid` one row per page with g0, pitch,
    height, long_leads. Short leads give 2.5 s, the rhythm strip 10 s. A lead that `maps`
    (record, lead, knots array<struct<a,b>>) names is read along its map of millimetres instead of the even
    columns. A profile has one row per page column, so it travels as one array per lead.
    """
    pages = grid.filter(F.col("reason").isNull()) if "reason" in grid.columns else grid
    rows = profile.withColumn("dx", shift if shift is not None else F.lit(0.0)).filter(F.col("lead").isin(*dims.LEADS))
    lines = rows.groupBy("record", "lead").agg(
        F.array_sort(F.collect_list(F.struct(F.col("col").cast("double").alias("col"), F.col("y").cast("double").alias("y")))).alias("line"), F.first("dx").alias("dx"))
    lines = lines.join(pages.select("record", "g0", "pitch", "height", "long_leads"), "record")
    lines = lines.join(maps, ["record", "lead"], "left") if maps is not None else lines.withColumn("knots", F.lit(None).cast("array<struct<a:double,b:double>>"))

    @F.pandas_udf("array<double>")
    def samples(lead: pd.Series, strip: pd.Series, pitch: pd.Series, g0: pd.Series, height: pd.Series, dx: pd.Series,
                cols: pd.Series, y: pd.Series, mm: pd.Series, at: pd.Series) -> pd.Series:
        rows = list(zip(lead, strip, pitch, g0, height, dx, cols, y, mm, at, strict=True))
        return pd.Series([v for i in range(0, len(rows), SIDE_BY_SIDE) for v in sampled(rows[i:i + SIDE_BY_SIDE], sharpened, rate)], dtype=object)

    mv = samples("lead", F.array_contains("long_leads", F.col("lead")), F.col("pitch").cast("double"), F.col("g0").cast("double"),
                 F.col("height").cast("double"), F.col("dx").cast("double"), "line.col", "line.y", "knots.a", "knots.b")
    return lines.select("record", "lead", F.posexplode(mv).alias("t", "mv")).withColumn("t", F.col("t").cast("bigint"))


def paper_windows(samples: DataFrame, rate: float, paper_seconds: float, columns: int = dims.N_COLUMNS,
                  start: Column | int = 0) -> DataFrame:
    """The printed part of each lead on every page of a recording.

    Pages follow each other every `paper_seconds`; on a page, a lead shows the stretch of
    its layout column. The rhythm lead also appears in full as a `full` row.
    """
    page = int(rate * paper_seconds)
    width = int(rate * paper_seconds / columns)
    table = F.create_map(*[F.lit(x) for kv in dims.COLUMN.items() for x in kv])
    local = F.col("t") - start
    rows = samples.withColumn("page", F.floor(local / page)).withColumn("_k", F.pmod(local, F.lit(page)))
    rows = rows.filter(local >= 0)
    column = F.coalesce(F.try_element_at(table, F.col("lead")), F.lit(0)) if columns == dims.N_COLUMNS else F.lit(0)
    short = rows.filter((F.col("_k") >= column * width) & (F.col("_k") < (column + 1) * width)).withColumn("full", F.lit(False))
    full = rows.filter(F.col("lead") == dims.RHYTHM_LEAD).withColumn("full", F.lit(True))
    return short.unionByName(full).drop("_k")
