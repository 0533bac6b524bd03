"""Pairing two evaluation runs, summarising one run, matching names by prefix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import count_where, finite, present, share, to_number
from .ordered import beside
from .quantiles import exact_quantiles

KEYS = ("record", "lead")


def usable_rows(df: DataFrame, metric: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Key and metric columns of the rows that are not missing and have a finite metric."""
    for name in (*keys, metric):
        if name not in df.columns:
            raise ValueError(f"Missing column '{name}' in the evaluation frame.")
    kept = df.filter(present("missing")) if "missing" in df.columns else df
    return kept.select(*keys, to_number(metric).alias(metric)).filter(finite(metric))


def pair_runs(run_a: DataFrame, run_b: DataFrame, metric: str = "snr_raw",
              keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner join of two runs on the keys with `a`, `b` and `delta = b - a`.

    Keys that occur more than once on a side multiply, as in any relational join.
    """
    a = usable_rows(run_a, metric, keys).withColumnRenamed(metric, "a")
    b = usable_rows(run_b, metric, keys).withColumnRenamed(metric, "b")
    return a.join(b, list(keys), "inner").withColumn("delta", F.col("b") - F.col("a"))


def pair_summary(paired: DataFrame, worse_at: float = -1.0) -> DataFrame:
    """Record and lead counts, medians, means and minima of both runs, shares of change."""
    plain = paired.agg(
        F.countDistinct("record").alias("n_records"),
        F.count(F.lit(1)).alias("n_leads"),
        F.avg("a").alias("a_mean"), F.min("a").alias("a_min"),
        F.avg("b").alias("b_mean"), F.min("b").alias("b_min"),
        share(F.col("delta") > 0).alias("frac_improved"),
        F.coalesce(count_where(F.col("delta") <= worse_at), F.lit(0)).alias("n_worse"),
    )
    medians = exact_quantiles(paired, [], {"a": "a", "b": "b"})
    return beside(plain, medians).select(
        "n_records", "n_leads", "a_median", "a_mean", "a_min", "b_median", "b_mean", "b_min",
        "frac_improved", "n_worse",
    )


def worse_rows(paired: DataFrame, threshold: float = -1.0) -> DataFrame:
    """Pairs that lost at least `-threshold` (inclusive), worst first."""
    return paired.filter(F.col("delta") <= threshold).orderBy("delta", *[c for c in KEYS if c in paired.columns])


def run_summary(evaluated: DataFrame, metrics: Sequence[str] = ("snr_raw",), overall: str = "*") -> DataFrame:
    """Per record and over everything: leads present, leads missing, medians and means.

    The overall row (record = `overall`) is the grand total of the same aggregation.
    """
    there = present("missing")
    tagged = evaluated.withColumn("record", F.explode(F.array(F.col("record").cast("string"), F.lit(overall))))
    cleaned = tagged.withColumns({m: F.when(there & finite(to_number(m)), to_number(m)) for m in metrics})
    counts = cleaned.groupBy("record").agg(
        count_where(there).alias("n_leads"),
        count_where(~there).alias("n_missing"),
        *[F.avg(m).alias(f"{m}_mean") for m in metrics],
    )
    medians = exact_quantiles(cleaned, ["record"], {m: m for m in metrics})
    return counts.join(medians, "record", "left")


def record_spread(evaluated: DataFrame, metric: str = "snr_raw") -> DataFrame:
    """Median and minimum of a metric over the non-missing leads of each record."""
    from ..functions.numbers import text_flag

    kept = evaluated.filter(~text_flag("missing")) if "missing" in evaluated.columns else evaluated
    kept = kept.select("record", to_number(metric).alias("x")).filter(finite("x"))
    low = kept.groupBy("record").agg(F.min("x").alias("snr_rec_min"))
    mid = exact_quantiles(kept, ["record"], {"snr_rec": "x"})
    return mid.join(low, "record")


def match_by_prefix(wanted: DataFrame, offered: DataFrame, wanted_name: str, offered_name: str,
                    separator: str = "-") -> DataFrame:
    """For each wanted name the equal offered name, else the smallest `<wanted>-...` name.

    Every offered name lists the stems it could answer for (itself and each part in
    front of a separator), which turns the prefix test into an equality join.
    """
    pieces = F.split(F.col(offered_name), separator)
    stems = F.transform(
        F.sequence(F.lit(1), F.size(pieces)),
        lambda n: F.array_join(F.slice(pieces, 1, n), separator),
    )
    stemmed = offered.select(F.col(offered_name).alias("_name"), F.explode(F.array_distinct(stems)).alias("_stem"))
    best = stemmed.groupBy("_stem").agg(
        F.min(F.struct((F.col("_name") != F.col("_stem")).alias("by_prefix"), F.col("_name").alias("name"))).alias("_m")
    )
    return (wanted.join(best, F.col(wanted_name) == F.col("_stem"), "inner")
            .select(*wanted.columns, F.col("_m.name").alias("match"), F.col("_m.by_prefix").alias("by_prefix")))
