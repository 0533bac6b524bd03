"""Cluster bootstrap and logistic fits as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.digests import md5_heads
from ..functions.numbers import finite, inverse_logistic_at, ratio
from ..functions.statistics import exact_interval_column
from ..session import pinned
from .agreement import equal_weights, kappa
from .ordered import beside, numbered, running_totals
from .quantiles import exact_quantiles

ROWS_PER_SALT = 200_000
PICKS_PER_TASK = 5_000_000


def seeded_pick(n, seed: int, *place):
    """A number from 0 to n - 1 that the seed and a place (columns) fix: 48 bits of their MD5 as a share of n."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in place]).cast("binary"))
    return F.floor(F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48)) * n).cast("bigint")


def cluster_picks(spark: SparkSession, n_clusters: int, n_boot: int, seed: int) -> DataFrame:
    """(draw, cluster, times): how often each cluster is drawn, with replacement.

    Slot s of draw d has the cluster that MD5 of (seed, d, s) points at, whatever the number of either.
    """
    return _slots(spark, n_clusters, n_boot, seed).groupBy("draw", "cluster").agg(F.count(F.lit(1)).cast("int").alias("times"))


def _slots(spark: SparkSession, n_clusters: int, n_boot: int, seed: int) -> DataFrame:
    """(draw, cluster): one row per slot of every draw."""
    picks = n_clusters * n_boot
    tasks = max(1, min(spark.sparkContext.defaultParallelism, picks // 10_000), -(-picks // PICKS_PER_TASK))
    slots = spark.range(0, picks, 1, tasks).select(
        F.floor(F.col("id") / F.lit(max(n_clusters, 1))).cast("int").alias("draw"), (F.col("id") % max(n_clusters, 1)).alias("slot"))
    return slots.select("draw", seeded_pick(F.lit(float(n_clusters)), seed, "draw", "slot").alias("cluster"))


def _indexed(df: DataFrame, cluster: str) -> tuple[DataFrame, int]:
    """Rows with a 0-based cluster number in name order, and the number of clusters."""
    names = numbered(df.select(cluster).distinct(), [], [cluster])
    names = pinned(names.select(cluster, (F.col("rn") - 1).alias("cluster"), F.col("rn_total").alias("_clusters")))
    head = names.select("_clusters").first()
    return df.join(names.drop("_clusters"), cluster), int(head[0]) if head else 0


def bootstrap_median(df: DataFrame, cluster: str, value: str, n_boot: int = 2000, seed: int = 0,
                     level: float = 0.95) -> DataFrame:
    """Median of `value` with a percentile interval from resampling whole clusters.

    Equal values of a cluster are counted once. The middle of nearly every draw lies in a narrow band of values, so a draw
    needs the numbers of rows of its clusters and the values of that band only (`_band_medians`); the others are added
    up in full (`_drawn_medians`).
    """
    counts = pinned(df.groupBy(cluster, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.agg(F.countDistinct(cluster).alias("n_clusters"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("n_rows"))
    rows, n_clusters = _indexed(counts, cluster)
    if n_clusters == 0 or n_boot <= 0:
        empty = F.lit(None).cast("double")
        point = exact_quantiles(counts, [], {"v": "v"}, weight="c").withColumnRenamed("v_median", "median")
        return beside(sizes, point).withColumns({"lo": empty, "hi": empty})
    told = counts.where(finite("v")).select(cluster, F.col("v").cast("double").alias("v"), "c")
    n, squares, largest = told.groupBy(cluster).agg(F.sum("c").cast("double").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.max("n")).first()
    reach = (BAND_SIGMAS * np.sqrt(squares) / 2 + 1) / n if n else 0.5  # half the clusters' sizes bound what a draw moves the middle by
    point = pinned(exact_quantiles(told, [], {"v": "v"}, {"median": 0.5, "low": max(0.5 - reach, 0.0), "high": min(0.5 + reach, 1.0)}, "c"))
    band = point.select("v_low", "v_high").first()
    rows = rows.where(finite("v")).select("cluster", F.col("v").cast("double").alias("v"), "c")
    slots = _slots(df.sparkSession, n_clusters, n_boot, seed)
    medians = _band_medians(rows, n_clusters, n_boot, seed, *band, int(largest)) if n else None
    if medians is None:
        medians = pinned(_drawn_medians(rows, slots))
    else:
        beyond = [r["draw"] for r in medians.where("NOT found").select("draw").collect()]  # n_boot at most
        if beyond:
            medians = pinned(medians.where("found").select("draw", "median").unionByName(_drawn_medians(rows, slots.where(F.col("draw").isin(beyond)))))
    tail = (1 - level) / 2
    ends = medians.agg(F.percentile("median", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    ends = ends.select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return beside(beside(sizes, point.select(F.col("v_median").alias("median"))), ends)


BINS = 128
BAND_SIGMAS = 6
BAND_CELLS = 1 << 19  # of the band, sent to every task
BLOCK = 1 << 16  # clusters whose numbers travel in one row
HELD = 1 << 26  # clusters whose numbers a task holds at once
GROUPS_PER_CORE = 4
PICKS_PER_GROUP = 1_000_000  # at least


def _band_medians(rows: DataFrame, n_clusters: int, n_boot: int, seed: int, low: float, high: float, largest: int) -> DataFrame | None:
    """(draw, median, found) of every draw; `found` is false where a middle rank is not in the band from `low` to `high`.

    None if the band has too many cells, or the largest cluster more rows than its code can tell. `rows` has (cluster, v, c).
    A task makes the picks of some draws itself and adds up two numbers of every cluster drawn, its rows and those below
    the band, besides the cells of the band. Both numbers of a cluster and whether it has such cells are one code of two
    bytes or a few. A task holds the codes of HELD clusters at once: with more, the picks are made once for each such part.
    """
    bits = largest.bit_length()
    if bits > 31:
        return None
    mask, marked, kind = (1 << bits) - 1, 1 << 2 * bits, f"u{2 if bits < 8 else 4 if bits < 16 else 8}"
    cells = rows.where((F.col("v") >= low) & (F.col("v") <= high)).limit(BAND_CELLS + 1).toPandas().sort_values("v")  # bounded
    if len(cells) > BAND_CELLS:
        return None
    value, times = cells["v"].to_numpy(dtype=float), cells["c"].to_numpy(dtype=np.int64)
    inside, place = np.unique(cells["cluster"].to_numpy(dtype=np.int64), return_inverse=True)
    spark, block, held = rows.sparkSession, BLOCK, HELD // BLOCK * BLOCK

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        codes = np.zeros(block, dtype=kind)
        codes[table["cluster"].to_numpy() % block] = table["n"].to_numpy() | table["below"].to_numpy() << bits
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "codes": [codes.tobytes()]})

    sums = rows.groupBy("cluster").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v") < low, F.col("c")).otherwise(0)).alias("below"))
    blocks = pinned(sums.withColumn("block", F.floor(F.col("cluster") / F.lit(block))).groupBy("block").applyInArrow(packed, "block bigint, codes binary"))

    def medians(n: int, below: int, drawn: np.ndarray) -> tuple[float | None, bool]:
        if n == 0:
            return None, True
        upto = np.cumsum(drawn[place] * times)
        first, last = (n - 1) // 2 - below, n // 2 - below
        if first < 0 or not upto.size or last >= upto[-1]:
            return None, False
        a, b = value[np.searchsorted(upto, [first, last], "right")]
        return float(a + (b - a) * ((n - 1) / 2 - (n - 1) // 2)), True

    def added(draws: range, start: int, codes: np.ndarray, sums: np.ndarray, drawn: np.ndarray) -> None:
        """The picks that fall into the clusters from `start` on, whose codes are given."""
        a, b = np.searchsorted(inside, [start, start + codes.size])
        codes[inside[a:b] - start] |= marked
        for i, draw in enumerate(draws):
            hits = []
            for heads in md5_heads(f"{seed}:{draw}:", 0, n_clusters):
                at = (heads * 2.0**-48 * float(n_clusters)).astype(np.int64)
                if codes.size < n_clusters:
                    at = at[(at >= start) & (at < start + codes.size)] - start
                told = codes.take(at, mode="clip")  # all are inside; this mode is the quickest
                sums[i] += (told & mask).sum(dtype=np.int64), (told >> bits & mask).sum(dtype=np.int64)
                hits.append(at[np.flatnonzero(told >= marked)])
            drawn[i, a:b] += np.bincount(np.searchsorted(inside[a:b], np.concatenate(hits) + start), minlength=b - a).astype(np.int32)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = ((r["group"], r["block"], r["codes"]) for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist())
        for group, mine in groupby(given, key=lambda r: r[0]):
            draws = range(group, n_boot, n_groups)
            sums, drawn = np.zeros((len(draws), 2), dtype=np.int64), np.zeros((len(draws), inside.size), dtype=np.int32)
            for part, some in groupby(mine, key=lambda r: r[1] * block // held):
                start = part * held
                codes = np.zeros(min(held, n_clusters - start), dtype=kind)
                for _, at, sent in some:
                    mine_here = codes[at * block - start:][:block]
                    mine_here[:] = np.frombuffer(sent, dtype=kind)[:mine_here.size]
                added(draws, start, codes, sums, drawn)
            found = [medians(int(n), int(below), d) for (n, below), d in zip(sums, drawn, strict=True)]
            yield pa.RecordBatch.from_pydict({"draw": pa.array(draws, pa.int32()), "median": pa.array([m for m, _ in found], pa.float64()),
                                              "found": pa.array([f for _, f in found], pa.bool_())})

    n_groups = max(1, min(n_boot, GROUPS_PER_CORE * spark.sparkContext.defaultParallelism, n_boot * n_clusters // PICKS_PER_GROUP))
    copies = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).select("group", "block", "codes")
    dealt = copies.repartitionById(n_groups, "group").sortWithinPartitions("group", "block")
    return pinned(dealt.mapInArrow(kernel, "draw int, median double, found boolean"))


def _drawn_medians(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """(draw, median) of every draw that has a value.

    `rows` has (cluster, v, c), `slots` (draw, cluster). Drawn rows are the product of both and are not
    shuffled: they are added up by bins of the value first, then only those in the bins that hold a middle rank are
    put in order. The bins cover all values, so any bounds give exact medians; even ones keep the second step short.
    """
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    bounds = np.unique(np.array(rows.agg(F.percentile_approx("v", shares)).first()[0] or [], dtype=float))

    @F.pandas_udf("int")
    def bin_of(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, v.to_numpy(dtype=float)).astype(np.int32))

    rows = rows.withColumn("bin", bin_of("v"))

    def drawn(few: DataFrame, by: Sequence[str]) -> DataFrame:
        return few.join(slots, "cluster").groupBy("draw", *by).agg(F.sum("c").alias("c"))

    one = Window.partitionBy("draw")
    levels = drawn(rows, ["bin"]).withColumns({
        "upto": F.sum("c").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("c").over(one)})
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    first = F.col("upto") - F.col("c")
    held = [(first <= r) & (r < F.col("upto")) for r in (low, high)]
    wanted = pinned(levels.where(held[0] | held[1]).select("draw", "bin", first.alias("before"), "total"))
    bins = F.broadcast(wanted.select("bin").distinct())  # BINS at most
    values = drawn(rows.join(bins, "bin", "left_semi"), ["bin", "v"]).join(F.broadcast(wanted), ["draw", "bin"])  # two rows a draw at most
    ranked = running_totals(values, ["draw", "bin"], ["v"], {"upto": "c"}).withColumn("upto", F.col("upto") + F.col("before"))
    ends = ranked.groupBy("draw", "total").agg(*[F.max(F.when(h, F.col("v"))).alias(n) for h, n in zip(held, ("low", "high"), strict=True)])
    return ends.select("draw", (F.col("low") + (F.col("high") - F.col("low")) * ((F.col("total") - 1) / 2 - low)).alias("median"))


def _draw_rows(counts: DataFrame, picks: DataFrame) -> DataFrame:
    """Join value counts with the draws of their cluster, large clusters over several salts."""
    salts = counts.groupBy("cluster").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_SALT)).cast("int").alias("n_salts"))
    left = counts.join(salts, "cluster").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("n_salts")).cast("int"))
    right = picks.join(salts, "cluster").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)))
    return left.drop("n_salts").join(right.drop("n_salts"), ["cluster", "salt"])


def bootstrap_sums(df: DataFrame, cluster: str, sums: Sequence[str], n_boot: int = 2000, seed: int = 0) -> DataFrame:
    """Per draw the sums of additive columns over the drawn clusters.

    Anything that is a function of sums (rates, kappa) is computed from the result; each
    cluster enters the join once, as one row of sums.
    """
    each = df.groupBy(cluster).agg(*[F.sum(s).alias(s) for s in sums])
    rows, n_clusters = _indexed(each, cluster)
    picks = cluster_picks(df.sparkSession, n_clusters, n_boot, seed)
    return picks.join(rows.drop(cluster), "cluster").groupBy("draw").agg(
        *[F.sum(F.col(s) * F.col("times")).alias(s) for s in sums])


def bootstrap_auroc(df: DataFrame, cluster: str, keys: Sequence[str], score: str, positive: str, n_boot: int = 1000,
                    seed: int = 0) -> DataFrame:
    """AUROC per (draw, key) over resampled clusters, ties averaged; NULL where a class is missing.

    Equal scores of a draw are counted before they are put in order.
    """
    keys = list(keys)
    pos = (F.col(positive).cast("int") == 1).cast("bigint")
    each = df.groupBy(F.col(cluster).alias("_cluster"), *keys, F.col(score).alias("v")).agg(
        F.sum(pos).alias("p"), F.sum(1 - pos).alias("q"))
    rows, n_clusters = _indexed(each, "_cluster")
    drawn = _draw_rows(rows.drop("_cluster"), cluster_picks(df.sparkSession, n_clusters, n_boot, seed))
    rungs = drawn.groupBy("draw", *keys, "v").agg(F.sum(F.col("p") * F.col("times")).alias("p"),
                                                  F.sum(F.col("q") * F.col("times")).alias("q"))
    ladder = running_totals(rungs, ["draw", *keys], ["v"], {"_q": "q", "_p": "p"})
    below = F.col("_q") - F.col("q") + F.col("q") / F.lit(2.0)
    out = ladder.groupBy("draw", *keys).agg(F.sum(F.col("p") * below).alias("_won"), F.max("_p_total").alias("_np"),
                                            F.max("_q_total").alias("_nq"))
    return out.select("draw", *keys, ratio("_won", F.col("_np").cast("double") * F.col("_nq")).alias("auroc"))


def decision_intervals(decided: DataFrame, n_boot: int = 2000, seed: int = 0, level: float = 0.95,
                       cluster: str = "record") -> DataFrame:
    """Kappa, flip rate, record flip rate and mean probability change with their intervals.

    Whole clusters (records, or the patients they belong to) are drawn, the same draws
    for every statistic. Without a single flip the intervals of kappa and the flip rates
    say nothing and are NULL; the exact interval of the record flip rate remains.
    """
    flag = lambda c: F.col(c).cast("double")
    names = list(dict.fromkeys(["record", cluster]))
    per_record = decided.groupBy(*names).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(flag("dec_ref")).alias("a"), F.sum(flag("dec_test")).alias("b"),
        F.sum(flag("flip")).alias("flips"), F.sum("abs_dp").alias("dp"), F.max(flag("flip")).alias("any"), F.lit(1.0).alias("one"))
    sums = ["n", "a", "b", "flips", "dp", "any", "one"]

    def statistics(totals: DataFrame) -> DataFrame:
        c = F.col
        return totals.withColumns({
            "kappa": kappa(c("n"), c("a"), c("b"), c("n") - c("flips")), "flip_rate": ratio("flips", "n"),
            "record_flip_rate": ratio("any", "one"), "mean_abs_dp": ratio("dp", "n")})

    point = statistics(per_record.agg(*[F.sum(s).alias(s) for s in sums]))
    draws = pinned(statistics(bootstrap_sums(per_record, cluster, sums, n_boot, seed)))
    wanted = ("kappa", "flip_rate", "record_flip_rate", "mean_abs_dp")
    out = point
    for name in wanted:
        ends = percentile_interval(draws, name, level).withColumnsRenamed(
            {"lo": f"{name}_lo", "hi": f"{name}_hi", "n_valid": f"{name}_valid"})
        out = beside(out, ends)
    moved = F.col("flips") > 0
    out = out.withColumns({f"{n}_{e}": F.when(moved, F.col(f"{n}_{e}")) for n in wanted[:3] for e in ("lo", "hi")})
    exact = exact_interval_column(F.col("any").cast("bigint"), F.col("one").cast("bigint"), level)
    return out.withColumn("_ci", exact).select(
        F.col("one").cast("bigint").alias("n_records"), F.col("flips").cast("bigint").alias("n_flips"), (~moved).alias("degenerate"),
        *[f"{n}{e}" for n in wanted for e in ("", "_lo", "_hi")], F.col("_ci.lo").alias("record_flip_exact_lo"),
        F.col("_ci.hi").alias("record_flip_exact_hi"))


def percentile_interval(draws: DataFrame, statistic: str, level: float = 0.95) -> DataFrame:
    """Percentile interval over the finite draws and how many they are (one row per draw comes in)."""
    tail = (1 - level) / 2
    kept = draws.filter(finite(statistic))
    return kept.agg(F.percentile(statistic, F.array(F.lit(tail), F.lit(1 - tail))).alias("q"),
                    F.count(F.lit(1)).alias("n_valid")).select(
        F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_valid")


def logistic_fit(df: DataFrame, x: str, flip: str, group: str, probs: Sequence[float] = (0.05, 0.1),
                 weighting: str = "rows", max_iter: int = 50, tol: float = 1e-12) -> DataFrame:
    """Unpenalised logistic curve flip ~ x, and the x at which given probabilities are reached.

    Newton steps on sums: each step is one aggregate of five numbers over pre-counted
    (x, outcome) pairs. Without a maximum likelihood estimate the reason is reported.
    """
    if weighting not in ("rows", "group"):
        raise ValueError(f"weighting must be rows or group, got {weighting!r}")
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(flip).cast("int").alias("y"),
                     F.col(group).alias("g")).filter(finite("x"))
    weighted = equal_weights(rows, "g") if weighting == "group" else rows.withColumn("weight", F.lit(1.0))
    cells = pinned(weighted.groupBy("x", "y").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")))
    per_group = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    groups = per_group.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()
    flipped = F.col("y") == 1
    s = cells.agg(
        F.sum("n").alias("n"), F.sum(F.when(flipped, F.col("n")).otherwise(0)).alias("k"),
        F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.max(F.when(flipped, F.col("x"))).alias("max1"), F.min(F.when(flipped, F.col("x"))).alias("min1"),
        F.max(F.when(~flipped, F.col("x"))).alias("max0"), F.min(F.when(~flipped, F.col("x"))).alias("min0"),
        F.avg("x").alias("mu"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("sd")).first()
    n, k = int(s["n"] or 0), int(s["k"] or 0)
    fit, b0, b1, converged = "ok", None, None, False
    if n == 0:
        fit = "degenerate: no rows"
    elif k == 0:
        fit = "degenerate: no flips"
    elif k == n:
        fit = "degenerate: all rows flip"
    elif s["lo"] == s["hi"]:
        fit = "degenerate: constant x"
    elif s["max1"] <= s["min0"] or s["min1"] >= s["max0"]:
        fit = "degenerate: separated"
    else:
        b0, b1, converged = _newton(cells, s["mu"], s["sd"] or 1.0, max_iter, tol)
    out = df.sparkSession.createDataFrame(
        [(weighting, n, int(groups[0]), int(groups[1] or 0), int(groups[2] or 0), k, s["lo"], s["hi"],
          b0, b1, converged, fit)],
        "weighting string, n_rows bigint, n_groups bigint, rows_per_group_min bigint, rows_per_group_max bigint, "
        "n_flips bigint, x_min double, x_max double, intercept double, slope double, converged boolean, fit string")
    return out.withColumns({
        f"x_at_p{p:g}".replace(".", "_"): inverse_logistic_at(p, "intercept", "slope") for p in probs})


def logistic_draws(df: DataFrame, x: str, flip: str, group: str, n_boot: int = 1000, seed: int = 0, weighting: str = "rows",
                   max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """(draw, fit, intercept, slope, steps, score_0, score_1): the curve of `logistic_fit` in every draw of whole groups.

    All draws take their Newton steps together: one aggregate per step with the draw as its key, over drawn values
    that are joined anew instead of kept; a draw that has converged leaves. `fit` says ok, stuck (no end within
    max_iter) or why a draw has no curve: one_outcome, constant, separated. The scores are the equations at the solution.
    """
    if weighting not in ("rows", "group"):
        raise ValueError(f"weighting must be rows or group, got {weighting!r}")
    spark = df.sparkSession
    rows = df.select(F.col(x).cast("double").alias("v"), F.col(flip).cast("int").alias("y"), F.col(group).alias("_group")).filter(finite("v"))
    rows = equal_weights(rows, "_group") if weighting == "group" else rows.withColumn("weight", F.lit(1.0))
    cells, n_groups = _indexed(rows.groupBy("_group", "v", "y").agg(F.sum("weight").alias("w")), "_group")
    cells = pinned(cells.drop("_group"))
    picks = pinned(cluster_picks(spark, n_groups, n_boot, seed))
    drawn = _draw_rows(cells, picks).select("draw", "v", "y", (F.col("w") * F.col("times")).alias("w"))
    yes = F.col("y") == 1
    span = [f(F.when(k, F.col("v"))).alias(n) for k, t in ((yes, "1"), (~yes, "0")) for f, n in ((F.min, f"lo{t}"), (F.max, f"hi{t}"))]
    shape = drawn.groupBy("draw").agg(*span)
    flat = F.greatest("hi1", "hi0") == F.least("lo1", "lo0")
    fit = (F.when(F.col("lo1").isNull() | F.col("lo0").isNull(), "one_outcome").when(flat, "constant")
           .when((F.col("hi1") <= F.col("lo0")) | (F.col("lo1") >= F.col("hi0")), "separated"))
    scale = cells.agg(F.avg("v"), F.stddev_pop("v")).first()
    mu, sd = float(scale[0] or 0.0), float(scale[1] or 1.0) or 1.0
    state = pinned(shape.select("draw", fit.alias("fit"), F.lit(0.0).alias("b0"), F.lit(0.0).alias("b1"), F.lit(0).alias("steps")))
    z = (F.col("v") - mu) / sd
    p = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * z)))
    r, h = F.col("w") * (F.col("y") - p), F.col("w") * p * (1 - p)
    sums = [F.sum(e).alias(n) for n, e in (("g0", r), ("g1", r * z), ("h0", h), ("h1", h * z), ("h2", h * z * z))]
    for _ in range(max_iter):
        active = state.where("fit IS NULL").select("draw", "b0", "b1")
        step = drawn.join(F.broadcast(active), "draw").groupBy("draw").agg(*sums)  # one row per draw
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        step = step.select("draw", F.when(det > 0, (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).alias("d0"),
                           F.when(det > 0, (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).alias("d1"))
        met = F.greatest(F.abs("d0"), F.abs("d1")) < tol
        mine = F.col("fit").isNull()
        state = pinned(state.join(step, "draw", "left").select(
            "draw", F.when(mine & F.col("d0").isNull(), "stuck").when(mine & met, "ok").otherwise(F.col("fit")).alias("fit"),
            (F.col("b0") + F.coalesce("d0", F.lit(0.0))).alias("b0"), (F.col("b1") + F.coalesce("d1", F.lit(0.0))).alias("b1"),
            (F.col("steps") + F.when(mine, 1).otherwise(0)).alias("steps")))
        if state.where("fit IS NULL").isEmpty():
            break
    state = state.withColumn("fit", F.coalesce("fit", F.lit("stuck")))
    score = drawn.join(F.broadcast(state.where("fit = 'ok'").select("draw", "b0", "b1")), "draw").groupBy("draw").agg(
        (F.sum(r) / F.sum("w")).alias("score_0"), (F.sum(r * z) / F.sum("w")).alias("score_1"))
    good = F.col("fit") == "ok"
    return state.join(score, "draw", "left").select(
        "draw", "fit", F.when(good, F.col("b0") - F.col("b1") * mu / sd).alias("intercept"), F.when(good, F.col("b1") / sd).alias("slope"),
        "steps", "score_0", "score_1")


def logistic_intervals(draws: DataFrame, probs: Sequence[float] = (0.05, 0.1), level: float = 0.95) -> DataFrame:
    """One row: percentile intervals of the slope and of x at each probability, over the draws that have all of them."""
    at = {"slope": F.col("slope")} | {f"x_at_p{p:g}".replace(".", "_"): inverse_logistic_at(p, "intercept", "slope") for p in probs}
    rows = draws.withColumns(at)
    usable = F.col("fit") == "ok"
    for name in at:
        usable = usable & F.coalesce(finite(name), F.lit(False))
    tail = (1 - level) / 2
    ends = rows.groupBy().agg(
        F.count(F.lit(1)).alias("n_boot"), F.count_if(usable).alias("n_valid"),
        *[F.percentile(F.when(usable, F.col(n)), F.array(F.lit(tail), F.lit(1 - tail))).alias(f"_{n}") for n in at])
    return ends.select("n_boot", "n_valid", (F.col("n_boot") - F.col("n_valid")).alias("n_degenerate"),
                       *[F.get(f"_{n}", F.lit(i)).alias(f"{n}_{e}") for n in at for i, e in enumerate(("lo", "hi"))])


def _newton(cells: DataFrame, mu: float, sd: float, max_iter: int, tol: float) -> tuple[float, float, bool]:
    b0 = b1 = 0.0
    z = (F.col("x") - mu) / sd
    for _ in range(max_iter):
        p = 1 / (1 + F.exp(-(F.lit(b0) + F.lit(b1) * z)))
        h, r = F.col("w") * p * (1 - p), F.col("w") * (F.col("y") - p)
        g0, g1, h00, h01, h11 = cells.agg(
            F.sum(r), F.sum(r * z), F.sum(h), F.sum(h * z), F.sum(h * z * z)).first()
        det = h00 * h11 - h01 * h01
        if det <= 0:
            return b0 - b1 * mu / sd, b1 / sd, False
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        b0, b1 = b0 + d0, b1 + d1
        if max(abs(d0), abs(d1)) < max(tol, 1e-10):
            return b0 - b1 * mu / sd, b1 / sd, True
    return b0 - b1 * mu / sd, b1 / sd, False
