"""Agreement of two sampled signals.

Signals are long tables with one row per (keys, sample index) and a value column.
All power sums are plain aggregates, so they are combined before any shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import two_way_average
from ..functions.numbers import decibel, finite, finite_or_null, ratio
from ..session import pinned
from .ordered import attach, by_grid, running_totals
from .quantiles import exact_quantiles

INF = float("inf")
PLACEMENTS = ("start", "window")  # fixed values, in order of preference
PAGE_SAMPLES = 5_000_000  # a signal of a page is far shorter; longer ones raise
SHIFT_CELLS = 4_000_000  # differences held at once


def sample_pairs(ref: DataFrame, est: DataFrame, keys: Sequence[str], t: str = "t", value: str = "mv") -> DataFrame:
    """Full outer join on the sample grid: `ref` and `est` are NULL where not finite or absent."""
    left = ref.select(*keys, t, finite_or_null(value).alias("ref"))
    right = est.select(*keys, t, finite_or_null(value).alias("est"))
    return left.join(right, [*keys, t], "full_outer")


def signal_snr(pairs: DataFrame, keys: Sequence[str], keep_gaps: bool = True,
               median_signal: bool = False, median_noise: bool = False) -> DataFrame:
    """SNR in dB per key with its powers.

    With `keep_gaps` only samples present on both sides count and the result is
    multiplied by the covered share of the reference; otherwise a missing estimate
    counts as 0. Powers are means, or medians on request.
    """
    est = F.col("est") if keep_gaps else F.coalesce("est", F.lit(0.0))
    used = F.col("ref").isNotNull() & (F.col("est").isNotNull() if keep_gaps else F.lit(True))
    work = pairs.select(
        *keys,
        F.col("ref").isNotNull().cast("int").alias("in_ref"),
        used.cast("int").alias("in_both"),
        F.when(used, F.col("ref") * F.col("ref")).alias("ps"),
        F.when(used, (F.col("ref") - est) * (F.col("ref") - est)).alias("pn"),
    )
    out = work.groupBy(*keys).agg(
        F.sum("in_ref").alias("n_ref"), F.sum("in_both").alias("n_both"),
        F.avg("ps").alias("p_signal"), F.avg("pn").alias("p_noise"))
    wanted = {n: n for n, on in (("ps", median_signal), ("pn", median_noise)) if on}
    if wanted:
        mid = exact_quantiles(work, keys, wanted)
        out = out.join(mid, list(keys), "left")
        if median_signal:
            out = out.withColumn("p_signal", F.col("ps_median")).drop("ps_median")
        if median_noise:
            out = out.withColumn("p_noise", F.col("pn_median")).drop("pn_median")
    snr = decibel("p_signal", "p_noise")
    if keep_gaps:
        snr = snr * ratio("n_both", "n_ref")
    return out.withColumn("snr", snr)


def pearson(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation over samples finite on both sides; NULL below two samples or without variance."""
    both = pairs.filter(F.col("ref").isNotNull() & F.col("est").isNotNull())
    return both.groupBy(*keys).agg(
        F.when((F.count(F.lit(1)) >= 2) & (F.min("ref") < F.max("ref")) & (F.min("est") < F.max("est")),
               F.corr("ref", "est")).alias("pearson_r"),
        F.count(F.lit(1)).alias("n_both"))


def valid_window(ref: DataFrame, keys: Sequence[str], t: str = "t", value: str = "mv") -> DataFrame:
    """First and one past the last finite sample per key (keys without one do not appear)."""
    return ref.filter(finite(value)).groupBy(*keys).agg(
        F.min(t).alias("window_start"), (F.max(t) + 1).alias("window_end"))


def cumulative_distance(pairs: DataFrame, keys: Sequence[str], t: str = "t", keep_gaps: bool = True,
                        grid: int = 65536) -> DataFrame:
    """1 - the largest gap between the normalised running sums of |ref| and |est|."""
    used = pairs.filter(F.col("ref").isNotNull())
    used = used.filter(F.col("est").isNotNull()) if keep_gaps else used
    work = used.select(*keys, t, F.abs("ref").alias("a"), F.abs(F.coalesce("est", F.lit(0.0))).alias("b"))
    run = running_totals(by_grid(work, t, grid), keys, [t], {"ra": "a", "rb": "b"}, segmented=True)

    def norm(n):
        return F.when(F.col(f"{n}_total") > 0, F.col(n) / F.col(f"{n}_total")).otherwise(F.col(n))

    return run.groupBy(*keys).agg((F.lit(1.0) - F.max(F.abs(norm("ra") - norm("rb")))).alias("ks"))


def signed_correlation_index(pairs: DataFrame, keys: Sequence[str], beta: float = 0.05,
                             keep_gaps: bool = True) -> DataFrame:
    """Mean of +1 / -1 per sample: +1 where the error is within beta x the reference's deviation."""
    if not 0 < beta <= 1:
        raise ValueError("beta must be greater than 0 and at most 1")
    used = pairs.filter(F.col("ref").isNotNull())
    used = used.filter(F.col("est").isNotNull()) if keep_gaps else used
    work = used.select(*keys, "ref", F.abs(F.col("ref") - F.coalesce("est", F.lit(0.0))).alias("err"))
    limit = work.groupBy(*keys).agg((F.lit(beta) * F.stddev_pop("ref")).alias("limit"), F.count(F.lit(1)).alias("_rows"))
    return attach(work, limit, keys).groupBy(*keys).agg(
        F.avg(F.when(F.col("err") <= F.col("limit"), 1.0).otherwise(-1.0)).alias("asci"))


def _over_shifts(ref: np.ndarray, est: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """SNR (NaN where undefined) and median offset for the shifts -reach..reach, many shifts at a time."""
    n = ref.size
    seen = np.concatenate([[0], np.cumsum(np.isfinite(ref))])
    moved = np.lib.stride_tricks.sliding_window_view(np.pad(est, reach, constant_values=np.nan), n)
    power = np.where(np.isfinite(ref), ref * ref, 0.0)
    shifts = np.arange(-reach, reach + 1)
    overlap = seen[n - np.maximum(shifts, 0)] - seen[np.maximum(-shifts, 0)]
    scores, offsets = [], []
    for some in np.array_split(np.arange(shifts.size), -(-shifts.size * n // SHIFT_CELLS)):
        gap = moved[some] - ref
        used = np.isfinite(gap)
        gap[~used] = np.nan
        count = used.sum(1)
        middle = np.nanmedian(gap, axis=1)
        noise = np.nanmean((gap - middle[:, None]) ** 2, axis=1)
        level = used @ power / count
        score = np.where(noise == 0, np.inf, np.where(level > 0, 10 * np.log10(level / noise) * count / overlap[some], np.nan))
        scores.append(np.where(count >= 2, score, np.nan))
        offsets.append(middle)
    return np.concatenate(scores), np.concatenate(offsets)


def aligned_snr(pairs: DataFrame, keys: Sequence[str], t: str = "t", max_shift: int = 50) -> DataFrame:
    """Best SNR over integer shifts in +-max_shift after removing the median offset.

    `pairs` holds samples on a 0-based grid, at most PAGE_SAMPLES per signal. A positive shift compares
    ref[i] with est[i + shift]; of equally good shifts the smallest counts.
    """
    keys = list(keys)
    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def search(at: np.ndarray, ref: np.ndarray, est: np.ndarray) -> tuple:
        n = int(at.max()) + 1
        if n > PAGE_SAMPLES:
            raise ValueError(f"a signal of {n} samples is longer than a page")
        x, y = np.full((2, n), np.nan)
        x[at], y[at] = ref, est
        reach = min(max_shift, n - 1)
        with warnings.catch_warnings(), np.errstate(all="ignore"):
            warnings.simplefilter("ignore", RuntimeWarning)  # shifts without a common sample
            score, offset = _over_shifts(x, y, reach)
        if np.isnan(score).all():
            return None, 0, None
        best = int(np.nanargmax(score))
        return float(score[best]), best - reach, float(offset[best])

    def kernel(batches):
        for batch in batches:
            rows = [search(*signal) for signal in zip(batch["_t"], batch["_r"], batch["_e"])]
            yield batch[keys].assign(**dict(zip(("snr_aligned", "shift", "offset"), zip(*rows))))

    nan = F.lit(float("nan"))
    arrays = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(t).cast("bigint").alias("t"), F.coalesce("ref", nan).alias("r"), F.coalesce("est", nan).alias("e")))).alias("_a"))
    arrays = arrays.select(*keys, *[F.col(f"_a.{n}").alias(f"_{n}") for n in ("t", "r", "e")])
    return arrays.mapInPandas(kernel, f"{fields}, snr_aligned double, shift int, offset double")


def evaluate_signals(ref: DataFrame, est: DataFrame, keys: Sequence[str] = ("record", "lead"),
                     placement: str = "auto", max_shift: int = 50) -> DataFrame:
    """One row of metrics per reference signal.

    The window of a signal runs from its first to its last finite reference sample. An
    estimate is read at the window (`window`) or from its own start (`start`); `auto`
    keeps whichever has the higher SNR, `start` on a tie. A signal that has no window
    or no estimate is reported as missing.
    """
    keys = list(keys)
    modes = PLACEMENTS if placement == "auto" else (placement,)
    window = valid_window(ref, keys)
    length = F.col("window_end") - F.col("window_start")
    ref_rows = (ref.join(window, keys).filter((F.col("t") >= F.col("window_start")) & (F.col("t") < F.col("window_end")))
                .select(*keys, (F.col("t") - F.col("window_start")).alias("t"), "mv",
                        F.explode(F.array(*[F.lit(m) for m in modes])).alias("placement")))
    est_rows = est.join(window, keys)
    placed = []
    if "start" in modes:
        placed.append(est_rows.filter(F.col("t") < length).select(*keys, "t", "mv", F.lit("start").alias("placement")))
    if "window" in modes:
        placed.append(est_rows.filter((F.col("t") >= F.col("window_start")) & (F.col("t") < F.col("window_end")))
                      .select(*keys, (F.col("t") - F.col("window_start")).alias("t"), "mv",
                              F.lit("window").alias("placement")))
    est_all = placed[0] if len(placed) == 1 else placed[0].unionByName(placed[1])
    pairs = pinned(sample_pairs(ref_rows, est_all, [*keys, "placement"]))  # read by every metric below
    scored = signal_snr(pairs, [*keys, "placement"])
    order = F.lit(0)
    for i, mode in enumerate(PLACEMENTS):
        order = F.when(F.col("placement") == mode, F.lit(-i)).otherwise(order)
    chosen = scored.groupBy(*keys).agg(F.max(F.struct(
        F.coalesce("snr", F.lit(-INF)).alias("rank"), order.alias("order"), "placement", "snr")).alias("c"))
    chosen = chosen.select(*keys, F.col("c.placement").alias("placement"), F.col("c.snr").alias("snr_raw"))
    kept = pairs.join(chosen.select(*keys, "placement"), [*keys, "placement"])
    aligned = aligned_snr(kept, keys, "t", max_shift)
    linear = pearson(kept, keys).drop("n_both")
    has_est = est.select(*keys).distinct().withColumn("_has", F.lit(True))
    base = ref.select(*keys).distinct().join(window, keys, "left").join(has_est, keys, "left")
    out = (base.join(chosen, keys, "left").join(aligned, keys, "left").join(linear, keys, "left")
           .withColumn("missing", F.col("_has").isNull() | F.col("window_start").isNull()))
    ok = ~F.col("missing")

    def unless_missing(name):
        return F.when(ok, F.col(name)).alias(name)

    return out.select(
        *keys,
        F.when(ok, F.col("placement")).otherwise(F.lit("")).alias("placement"),
        F.coalesce(F.col("window_end") - F.col("window_start"), F.lit(0)).alias("n_samples"),
        F.coalesce("window_start", F.lit(-1)).alias("window_start"),
        F.coalesce("window_end", F.lit(-1)).alias("window_end"),
        unless_missing("snr_raw"), unless_missing("pearson_r"), unless_missing("snr_aligned"),
        unless_missing("shift"), unless_missing("offset"), "missing")


def snr_check(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Largest difference to the SNR column of an evaluation frame, matched by record and lead."""
    from ..functions.numbers import text_flag, to_number

    kept = theirs.filter(~text_flag("missing")) if "missing" in theirs.columns else theirs
    right = kept.select(F.col("record"), F.upper("lead").alias("lead"), to_number("snr_raw").alias("theirs"))
    left = ours.select(F.col("record"), F.upper("lead").alias("lead"), F.col("snr").alias("ours"))
    both = left.join(right, ["record", "lead"])
    a, b = finite("ours"), finite("theirs")
    return both.agg(
        F.max(F.when(a & b, F.abs(F.col("ours") - F.col("theirs")))).alias("snr_check_max_absdiff"),
        F.coalesce(F.sum((a & b).cast("int")), F.lit(0)).alias("snr_check_n_leads"),
        F.coalesce(F.sum((a != b).cast("int")), F.lit(0)).alias("snr_check_n_mismatch"))


def weighted_difference(pairs: DataFrame, keys: Sequence[str], fs: float, t: str = "t",
                        keep_gaps: bool = True) -> DataFrame:
    """Mean absolute difference, weighted less where the smoothed reference is high.

    Weights are 1 - w / (2 max w) with w the reference averaged over a tenth of a second
    in both directions.
    """
    keys = list(keys)
    m = round(0.1 * fs)
    used = pairs.filter(F.col("ref").isNotNull())
    used = used.filter(F.col("est").isNotNull()) if keep_gaps else used
    arrays = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(t).alias("t"), F.col("ref").alias("r"), F.coalesce("est", F.lit(0.0)).alias("e")))).alias("_a"))

    @F.pandas_udf("double")
    def score(ref: pd.Series, est: pd.Series) -> pd.Series:
        def one(x, y):
            w = two_way_average(np.asarray(x, float), m)
            w = 1 - 0.5 / w.max() * w if w.max() != 0 else np.ones_like(w)
            return float(np.sum(np.abs(x - y) * w) / w.sum())
        return pd.Series([one(a, b) for a, b in zip(ref, est)])

    return arrays.select(*keys, score(F.col("_a.r"), F.col("_a.e")).alias("weighted_difference"))
