"""What a reading costs downstream: signals as the classifier sees them, and one row of figures per condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, finite, ratio
from . import agreement, metrics, signals
from .quantiles import exact_quantiles


def prepared_snr(ref: DataFrame, test: DataFrame, keys: Sequence[str], fs_in: float, fs_out: float = 100, n_out: int = 1000) -> DataFrame:
    """(keys, n_window, p_signal, p_noise, snr) of two readings after both were prepared for the classifier.

    Both have a row per sample of their grid, without a value in gaps. The window of a signal is where the prepared
    reference carries it: from its first to its last finite sample. A test signal that is absent, too short or without a
    value counts as 0 there, which is what the classifier would get. Errors above the resampler's band are gone.
    """
    keys = list(keys)
    return _in_window(signals.prepare(ref, keys, fs_in, fs_out, n_out), signals.prepare(test, keys, fs_in, fs_out, n_out), keys)


def snr_of_prepared(prepared: DataFrame, ref: str = "masked", test: str = "read", keys: Sequence[str] = ("record", "lead")) -> DataFrame:
    """The same figures from prepared signals of several kinds (keys, kind, t, y, in_span)."""
    ours = [prepared.filter(F.col("kind") == kind).drop("kind") for kind in (ref, test)]
    return _in_window(*ours, list(keys))


def _in_window(ref: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    window = ref.filter("in_span").select(*keys, "t", F.col("y").cast("double").alias("ref"))
    read = test.select(*keys, "t", F.col("y").cast("double").alias("est"))
    pairs = window.join(read, [*keys, "t"], "left").withColumn("est", F.coalesce("est", F.lit(0.0)))
    return metrics.signal_snr(pairs, keys).withColumnRenamed("n_ref", "n_window").drop("n_both")


def window_losses(truth: DataFrame, reading: DataFrame, keys: Sequence[str], t: str = "t", value: str = "mv") -> DataFrame:
    """(keys, n_window, n_nan, missing) per signal of the truth: samples inside its window and how many the reading lost."""
    read = reading.filter(finite(value)).select(*keys, t, F.lit(1).alias("_read"))
    inside = truth.filter(finite(value)).select(*keys, t).join(read, [*keys, t], "left")
    out = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_window"), count_where(F.col("_read").isNull()).alias("n_nan"))
    return out.withColumn("missing", F.col("n_nan") == F.col("n_window"))


def _pooled(kind: str) -> Column:
    return agreement.kappa(F.sum("n").cast("double"), F.sum(f"ref{kind}"), F.sum(f"test{kind}"), F.sum("n") - F.sum(f"flips{kind}"))


def condition_table(logits: DataFrame, classes: Sequence[str], losses: DataFrame | None = None, evaluation: DataFrame | None = None) -> DataFrame:
    """One row per condition: agreement at two sets of thresholds, ranking, lost samples, SNR.

    `logits` has (condition, record, class, thr, thr_full, z_ref, z_test, y), y NULL for records without labels; `losses`
    (condition, n_window, n_nan, missing) per signal; `evaluation` (condition, snr_raw, missing). Decisions are summed per
    class first, so a condition with a third of all records is combined before the shuffle. A class without both kinds of
    labels has no retention and takes no part in the macro means; a condition without labels, losses or evaluation has
    NULL there. Signals without any sample count as missing and not in the share of lost ones.
    """
    decided = agreement.with_decisions(logits)
    full_ref, full_test = agreement.decide("z_ref", "thr_full"), agreement.decide("z_test", "thr_full")
    decided = decided.withColumns({"full_ref": full_ref, "full_test": full_test}).withColumn("full_flip", F.col("full_ref") != F.col("full_test"))

    per_class = decided.groupBy("condition", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("abs_dp").alias("dp"), F.max("abs_dp").alias("top"),
        *[F.sum(F.col(c).cast("double")).alias(name) for c, name in (
            ("dec_ref", "ref"), ("dec_test", "test"), ("flip", "flips"), ("full_ref", "ref_full"), ("full_test", "test_full"), ("full_flip", "flips_full"))])
    own = agreement.kappa(F.col("n").cast("double"), F.col("ref"), F.col("test"), F.col("n") - F.col("flips"))
    out = per_class.withColumn("_k", own).groupBy("condition").agg(
        _pooled("").alias("kappa"), *[F.max(F.when(F.col("class") == c, F.col("_k"))).alias(f"kappa_{c}") for c in classes],
        F.sum("flips").cast("bigint").alias("n_flips"), (F.sum("flips") / F.sum("n")).alias("flip_rate"),
        (F.sum("dp") / F.sum("n")).alias("mean_abs_dp"), F.max("top").alias("max_abs_dp"),
        _pooled("_full").alias("kappa_thrfull"), (F.sum("flips_full") / F.sum("n")).alias("flip_rate_thrfull"))

    records = decided.groupBy("condition", "record").agg(F.bool_or("flip").alias("any"), F.bool_or("full_flip").alias("any_full"))
    out = out.join(records.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_records"), count_where(F.col("any")).alias("n_record_flips"),
        F.avg(F.col("any").cast("double")).alias("record_flip_rate"), F.avg(F.col("any_full").cast("double")).alias("record_flip_rate_thrfull")), "condition")

    systems = F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"z_{s}").alias("z")) for s in ("ref", "test")]))
    each = agreement.auroc(logits.filter("y IS NOT NULL").select("condition", "class", "y", systems), ["condition", "class", "system"], "z", "y")
    wide = each.groupBy("condition", "class").agg(
        *[F.max(F.when(F.col("system") == s, F.col("auroc"))).alias(s) for s in ("ref", "test")], F.max("n_pos").alias("n_pos"))
    both = F.col("ref").isNotNull() & F.col("test").isNotNull()
    ranking = wide.groupBy("condition").agg(
        F.avg(F.when(both, F.col("ref"))).alias("auroc_ref_macro"), F.avg(F.when(both, F.col("test"))).alias("auroc_test_macro"),
        *[F.max(F.when(F.col("class") == c, ratio("test", "ref"))).alias(f"ret_{c}") for c in classes],
        *[F.max(F.when(F.col("class") == c, F.col("n_pos"))).alias(f"npos_{c}") for c in classes])
    out = out.join(ranking.withColumn("auroc_retention_macro", ratio("auroc_test_macro", "auroc_ref_macro")), "condition", "left")

    if losses is not None:
        kept = ~F.col("missing")
        lost = losses.groupBy("condition").agg(F.sum(F.when(kept, F.col("n_nan"))).alias("_nan"), F.sum(F.when(kept, F.col("n_window"))).alias("_all"),
                                               count_where(F.col("missing")).alias("missing_leads"))
        out = out.join(lost.select("condition", ratio("_nan", "_all").alias("interior_nan_frac"), "missing_leads"), "condition", "left")
    if evaluation is not None:
        middle = exact_quantiles(evaluation.filter(~F.col("missing")), ["condition"], {"snr": "snr_raw"})
        out = out.join(middle.withColumnRenamed("snr_median", "snr_median_db"), "condition", "left")
    return out
