"""Ordered computations that stay spread out however large one key is.

A plain `Window.partitionBy(key)` sends every row of a key to one task. Here rows
are cut into segments first, each segment is scanned on its own, and only one
summary row per (key, segment) is looked at per key. Segments come from

* range partitioning on (keys, order): Spark samples the data and cuts hot keys
  into as many ranges as they need; or
* a given segment column that is a pure function of the row (a sample grid, a
  calendar), which needs no sampling and no checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned

SEGMENT = "_segment"


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row frame (a total, a count) next to every row."""
    key = "_one"
    return df.withColumn(key, F.lit(1)).join(F.broadcast(one_row.withColumn(key, F.lit(1))), key).drop(key)


def for_each(df: DataFrame, short: DataFrame) -> DataFrame:
    """Every row once per entry of a short domain list (the leads, the labels of a model)."""
    entries = short.agg(F.collect_set(F.struct(*short.columns)).alias("_entries"))
    return beside(df, entries).select(*df.columns, F.inline("_entries"))


HOT_ROWS = 4_000_000  # rows of one key that a task may be given
HOT_KEYS = 512


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], n_rows: str = "_rows") -> DataFrame:
    """Inner join of rows with one row of facts per key, however many rows a key has.

    A join followed by a grouping on the same keys is not split by AQE, so keys that
    hold more than 1 / HOT_KEYS of all rows (and more than HOT_ROWS) get their facts by
    broadcast. There can be no more than HOT_KEYS of them. `n_rows` names the number of
    rows per key in `facts`; it is dropped.
    """
    keys = list(keys)
    total = facts.agg(F.sum(n_rows).alias("_total"))
    limit = F.greatest(F.lit(HOT_ROWS), F.col("_total") / F.lit(HOT_KEYS))
    hot = beside(facts, total).filter(F.col(n_rows) > limit).drop("_total", n_rows)
    if hot.isEmpty():
        return rows.join(facts.drop(n_rows), keys)
    hot = pinned(hot)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.drop(n_rows), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`df` with a segment number from a range partitioning on (keys, order).

    The partition number is written out before it is used: bounds are sampled, so
    a recomputed stage must not be able to assign other numbers.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return pinned(spread.withColumn(SEGMENT, F.spark_partition_id()))


def by_grid(df: DataFrame, position: str, width: int) -> DataFrame:
    """Segments of `width` integer positions: at most `width` distinct positions each."""
    return df.withColumn(SEGMENT, F.floor(F.col(position) / F.lit(width)))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    segmented: bool = False,
) -> DataFrame:
    """Inclusive prefix sums within `keys` along `order`, plus the totals of each key.

    `sums` maps an output name to what is summed; the result gains `<name>` (prefix
    sum up to and including the row) and `<name>_total`. `order` must be unique
    within a key for a well-defined result. With `segmented`, `df` already carries
    a segment column whose numbers follow `order`.
    """
    keys, order = list(keys), list(order)
    inputs = {name: F.col(e) if isinstance(e, str) else e for name, e in sums.items()}
    work = df.withColumns({f"_in_{n}": e for n, e in inputs.items()})
    if not segmented:
        work = by_range(work, keys, order)
    inside = Window.partitionBy(*keys, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = work.groupBy(*keys, SEGMENT).agg(*[F.sum(f"_in_{n}").alias(f"_part_{n}") for n in inputs])
    along = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = along.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(SEGMENT).alias("_k_segment"),
        *[F.coalesce(F.sum(f"_part_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in inputs],
        *[F.sum(f"_part_{n}").over(along).alias(f"{n}_total") for n in inputs],
    )
    local = work.withColumns({f"_run_{n}": F.sum(f"_in_{n}").over(inside) for n in inputs})
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(SEGMENT) == F.col("_k_segment")]
    joined = local.join(parts, match, "inner")
    joined = joined.withColumns({n: F.col(f"_run_{n}") + F.col(f"_base_{n}") for n in inputs})
    drop = [f"_{p}_{n}" for n in inputs for p in ("in", "run", "base")]
    return joined.drop(*drop, *[f"_k_{k}" for k in keys], "_k_segment", SEGMENT)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
             segmented: bool = False) -> DataFrame:
    """Dense 1-based row number within `keys`; adds `<name>` and `<name>_total` (group size)."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, segmented)


def grid_numbered(df: DataFrame, keys: Sequence[str], position: str, name: str = "rn",
                  width: int = 65536) -> DataFrame:
    """`numbered` for series with at most one row per integer position: no checkpoint needed."""
    return numbered(by_grid(df, position, width), keys, [position], name, segmented=True)


def neighbourhood(
    df: DataFrame,
    keys: Sequence[str],
    row_number: str,
    reach: int,
    build: Callable[[Window], Mapping[str, Column]],
    chunk: int = 65536,
) -> DataFrame:
    """Window expressions that look at most `reach` rows away, in bounded chunks.

    Rows are cut into chunks of `chunk` row numbers; the `reach` rows on either side
    of a cut are copied to the neighbouring chunk, so every frame is complete.
    """
    n = F.col(row_number)
    home = F.floor(n / F.lit(chunk))
    spots = F.array_distinct(F.array(F.floor((n - reach) / F.lit(chunk)), home, F.floor((n + reach) / F.lit(chunk))))
    placed = df.withColumn("_home", home).withColumn("_chunk", F.explode(spots))
    window = Window.partitionBy(*keys, "_chunk").orderBy(row_number)
    out = placed.withColumns(dict(build(window)))
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")


def value_neighbourhood(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    half_width: float,
    build: Callable[[Window], Mapping[str, Column]],
    chunk: float | None = None,
) -> DataFrame:
    """Window expressions over the closed value range +- `half_width`, in bounded chunks."""
    size = float(chunk if chunk is not None else 64 * half_width)
    v = F.col(value).cast("double")
    home = F.floor(v / F.lit(size))
    spots = F.sequence(F.floor((v - half_width) / F.lit(size)), F.floor((v + half_width) / F.lit(size)))
    placed = (df.withColumn("_value", v).withColumn("_home", home).withColumn("_chunk", F.explode(spots)))
    by = ", ".join(f"`{k}`" for k in (*keys, "_chunk"))
    half = f"{float(half_width)!r}D"
    over = f"OVER (PARTITION BY {by} ORDER BY `_value` RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    out = placed.withColumns({name: F.expr(sql) for name, sql in build(over).items()})
    return out.filter(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home", "_value")
