"""Exact grouped quantiles that never gather a group in one task.

Spark's `percentile` keeps every distinct value of a group in one aggregation
buffer. Here equal values are counted first (combined before the shuffle), counts
are accumulated over range-partitioned segments, and the one or two rows that hold
the wanted ranks are picked out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import finite
from .ordered import running_totals

MEDIAN = {"median": 0.5}


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str | Column],
    probs: Mapping[str, float] = MEDIAN,
    weight: str | None = None,
) -> DataFrame:
    """One row per key with `<value>_<prob>` columns (linear interpolation).

    Non-finite values are left out per value column. `weight` is an integer column
    with the multiplicity of a row. Keys without a single finite value do not appear.
    """
    keys = list(keys)
    names = list(values)
    pairs = [
        F.struct(F.lit(i).alias("m"), (F.col(e) if isinstance(e, str) else e).cast("double").alias("v"))
        for i, e in enumerate(values.values())
    ]
    w = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    if len(pairs) == 1:
        long = df.select(*keys, F.lit(0).alias("_m"), pairs[0]["v"].alias("_v"), w.alias("_w"))
    else:
        long = (df.select(*keys, F.explode(F.array(*pairs)).alias("_p"), w.alias("_w"))
                .select(*keys, F.col("_p.m").alias("_m"), F.col("_p.v").alias("_v"), "_w"))
    counts = (long.filter(finite("_v")).groupBy(*keys, "_m", "_v").agg(F.sum("_w").alias("_c"))
              .filter(F.col("_c") > 0))
    ranked = running_totals(counts, [*keys, "_m"], ["_v"], {"_n": "_c"})
    first, last, total = F.col("_n") - F.col("_c"), F.col("_n") - 1, F.col("_n_total")
    hit = {}
    for alias, p in probs.items():
        place = F.lit(float(p)) * (total - 1)
        low, high = F.floor(place), F.ceil(place)
        hit[alias] = (place - low, (first <= low) & (low <= last), (first <= high) & (high <= last))
    wanted = ranked.filter(_any(h for _, a, b in hit.values() for h in (a, b)))
    aggs = []
    for i, name in enumerate(names):
        mine = F.col("_m") == i
        for alias, (part, at_low, at_high) in hit.items():
            low = F.max(F.when(mine & at_low, F.col("_v")))
            high = F.max(F.when(mine & at_high, F.col("_v")))
            step = F.max(F.when(mine, part))
            aggs.append((low + (high - low) * step).alias(f"{name}_{alias}"))
    grouped = wanted.groupBy(*keys) if keys else wanted.groupBy()
    return grouped.agg(*aggs)


def _any(conditions) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result
