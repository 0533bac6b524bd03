"""Inputs of a condition: original, printed truth and reading of every record, reconciled before use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, finite

# Why a record cannot be used.
NO_ORIGINAL, OTHER_SIZE, OTHER_RATE, DEVIATES, OTHER_READING = "no_original", "other_size", "other_rate", "deviates", "other_reading"


def _shape(samples: DataFrame, prefix: str, t: str) -> DataFrame:
    rate = F.max("fs") if "fs" in samples.columns else F.lit(None).cast("double")
    return samples.groupBy("record").agg(
        F.countDistinct("lead").alias(f"{prefix}_leads"), (F.max(t) + 1).alias(f"{prefix}_length"), rate.cast("double").alias(f"{prefix}_fs"))


def reconciled(truth: DataFrame, original: DataFrame, reading: DataFrame, tolerance: float = 1e-6, t: str = "t", value: str = "mv",
               order: Column | None = None) -> DataFrame:
    """(record, reason, present, n_window, n_off, first_t, first_lead, worst, n_read), one row per record of the truth.

    All three have (record, lead, t, mv[, fs]); a sample without a row is a sample without a value. The truth has
    values inside the printed windows only. There the original must equal it within `tolerance`, a missing value
    being no equal; `first_t` and `first_lead` name the first sample that does not (leads in `order`, by name unless
    given), `worst` the largest difference of two values. Lengths, numbers of leads and rates must agree as well. A record
    without a reading is used as one that lost every sample (`present` is false). `n_read` counts the samples read inside the windows.
    """
    keys = ["record", "lead", t]
    inside = truth.filter(finite(value)).select(*keys, F.col(value).alias("_true"))
    drawn = original.select(*keys, F.when(finite(value), F.col(value)).alias("_orig"))
    read = reading.filter(finite(value)).select(*keys, F.lit(1).alias("_read"))
    rows = inside.join(drawn, keys, "left").join(read, keys, "left")
    gap = F.abs(F.col("_orig") - F.col("_true"))
    off = gap.isNull() | (gap > tolerance)
    place = order if order is not None else F.lit(0)
    facts = rows.groupBy("record").agg(
        F.count(F.lit(1)).alias("n_window"), count_where(off).alias("n_off"), F.max(gap).alias("worst"), count_where(F.col("_read").isNotNull()).alias("n_read"),
        F.min(F.when(off, F.struct(F.col(t).alias("t"), place.alias("o"), F.col("lead").alias("lead")))).alias("first"))
    out = _shape(truth, "a", t).join(_shape(original, "b", t), "record", "left").join(_shape(reading, "c", t), "record", "left").join(facts, "record", "left")

    def differs(kind: str, other: str) -> Column:
        return ~F.col(f"a_{kind}").eqNullSafe(F.col(f"{other}_{kind}"))

    present = F.col("c_length").isNotNull()
    reason = (F.when(F.col("b_length").isNull(), NO_ORIGINAL).when(differs("leads", "b") | differs("length", "b"), OTHER_SIZE).when(differs("fs", "b"), OTHER_RATE)
              .when(F.col("n_off") > 0, DEVIATES).when(present & (differs("leads", "c") | differs("length", "c") | differs("fs", "c")), OTHER_READING))
    return out.select("record", reason.alias("reason"), present.alias("present"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_window", "n_off")],
                      F.col("first.t").alias("first_t"), F.col("first.lead").alias("first_lead"), "worst", F.coalesce("n_read", F.lit(0)).alias("n_read"))


def masked_inputs(truth: DataFrame, original: DataFrame, reading: DataFrame, checked: DataFrame, kinds: Sequence[str] = ("full", "masked", "read"),
                  t: str = "t", value: str = "mv") -> DataFrame:
    """(record, lead, t, kind, mv) of the records without a reason: the original, its part inside the windows, and the reading's."""
    good = checked.filter("reason IS NULL").select("record")
    keys = ["record", "lead", t]
    window = truth.filter(finite(value)).select(*keys)
    parts = {"full": original.select(*keys, value), "masked": window.join(original.select(*keys, value), keys, "left"),
             "read": window.join(reading.select(*keys, value), keys, "left")}
    out = None
    for kind in kinds:
        part = parts[kind].join(good, "record", "left_semi").select(*keys, F.lit(kind).alias("kind"), F.when(finite(value), F.col(value)).alias(value))
        out = part if out is None else out.unionByName(part)
    return out
