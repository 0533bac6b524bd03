"""Agreement of two sets of class decisions.

Inputs are long tables: one row per (record, class) with the logits of a reference and
a test system, a threshold, and possibly a 0/1 label.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col, count_where, finite, logistic, ratio
from .ordered import attach, beside, running_totals
from .quantiles import exact_quantiles

CUTS = (0.25, 0.5, 1.0)  # fixed values: margin cuts that are reported


def decide(score, threshold) -> Column:
    """Strictly above the threshold; a NaN or missing score or threshold decides False."""
    s, t = col(score), col(threshold)
    return F.coalesce(F.when(F.isnan(s) | F.isnan(t), False).otherwise(s > t), F.lit(False))


def with_decisions(logits: DataFrame, threshold_test: str = "thr") -> DataFrame:
    """Adds the two decisions, whether they differ, and |difference of probabilities|."""
    return logits.withColumns({
        "dec_ref": decide("z_ref", "thr"), "dec_test": decide("z_test", threshold_test),
    }).withColumns({
        "flip": F.col("dec_ref") != F.col("dec_test"),
        "abs_dp": F.abs(logistic("z_ref") - logistic("z_test")),
    })


def kappa(n: Column, ones_a: Column, ones_b: Column, agree: Column) -> Column:
    """Cohen's kappa of two binary raters from sums; 1 for two constant, identical raters."""
    pa, pb, po = ones_a / n, ones_b / n, agree / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(n > 0, F.when(pe >= 1.0 - 1e-12, F.lit(1.0)).otherwise((po - pe) / F.when(pe < 1, 1 - pe)))


def _ones(name: str) -> Column:
    return F.sum(F.col(name).cast("double"))


def decision_summary(decided: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Kappa, flips and probability changes, pooled over every (record, class) of a key."""
    n = F.count(F.lit(1)).cast("double")
    agree = F.sum((~F.col("flip")).cast("double"))
    out = decided.groupBy(*keys).agg(
        F.countDistinct("record").alias("n_records"),
        F.count(F.lit(1)).alias("n_decisions"),
        kappa(n, _ones("dec_ref"), _ones("dec_test"), agree).alias("kappa"),
        count_where(F.col("flip")).alias("n_flips"),
        (_ones("flip") / n).alias("flip_rate"),
        F.avg("abs_dp").alias("mean_abs_dp"), F.max("abs_dp").alias("max_abs_dp"))
    mid = exact_quantiles(decided, keys, {"abs_dp": "abs_dp"}).withColumnRenamed("abs_dp_median", "median_abs_dp")
    return out.join(mid, list(keys), "left") if keys else beside(out, mid)


def record_flips(decided: DataFrame) -> DataFrame:
    """Per record: flipped classes in class order, size of the changes, smallest margin.

    The classes are collected as a set, so the list is as short as the class list.
    """
    margin = F.abs(F.col("z_ref") - F.col("thr"))
    names = F.array_join(F.transform(
        F.array_sort(F.collect_set(F.when(F.col("flip"), F.struct("class_order", "class")))),
        lambda s: s["class"]), ";")
    return decided.groupBy("record").agg(
        count_where(F.col("flip")).alias("n_class_flips"),
        F.bool_or("flip").alias("any_flip"),
        names.alias("flipped_classes"),
        F.avg("abs_dp").alias("mean_abs_dp"), F.max("abs_dp").alias("max_abs_dp"),
        F.max(F.abs(F.col("z_test") - F.col("z_ref"))).alias("max_abs_dlogit"),
        F.min(F.when(finite(margin), margin)).alias("min_margin_ref"))


def record_flip_rate(per_record: DataFrame) -> DataFrame:
    return per_record.agg(
        F.count(F.lit(1)).alias("n_records"), count_where(F.col("any_flip")).alias("n_record_flips"),
        F.avg(F.col("any_flip").cast("double")).alias("record_flip_rate"))


def class_flips(decided: DataFrame) -> DataFrame:
    return decided.groupBy("class").agg(count_where(F.col("flip")).alias("n_flips"))


def split_halves(decided: DataFrame, id_column: str) -> DataFrame:
    """Flips and mean logit change overall and per id parity, one row per class."""
    change = F.col("z_test") - F.col("z_ref")
    aggs = []
    for half, keep in (("odd", F.col(id_column) % 2 == 1), ("even", F.col(id_column) % 2 == 0)):
        aggs += [
            count_where(keep).alias(f"n_records_{half}"),
            count_where(keep & F.col("flip")).alias(f"n_flips_{half}"),
            F.avg(F.when(keep, F.col("flip").cast("double"))).alias(f"flip_rate_{half}"),
            F.avg(F.when(keep, change)).alias(f"mean_change_{half}")]
    return decided.groupBy("class").agg(F.avg(change).alias("mean_change"), *aggs)


def score_ladder(df: DataFrame, keys: Sequence[str], score: str, positive: str, descending: bool) -> DataFrame:
    """Positives and negatives per distinct score with running and total counts."""
    pos = (F.col(positive).cast("int") == 1).cast("bigint")
    rungs = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    rungs = rungs.withColumn("_o", -F.col("score") if descending else F.col("score"))
    return running_totals(rungs, keys, ["_o"], {"cum_pos": "pos", "cum_neg": "neg"}).drop("_o")


def auroc(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve with ties averaged, and its support; NULL for one class only."""
    ladder = score_ladder(df, keys, score, positive, descending=False)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0)
    out = ladder.groupBy(*keys).agg(
        F.sum(F.col("pos") * below).alias("_won"),
        F.max("cum_pos_total").alias("n_pos"), F.max("cum_neg_total").alias("n_neg"))
    return out.withColumn("auroc", ratio("_won", F.col("n_pos").cast("double") * F.col("n_neg"))).drop("_won")


def auroc_retention(labelled: DataFrame) -> DataFrame:
    """Per class the AUROC of both systems and their ratio (labelled records only)."""
    systems = F.explode(F.array(
        F.struct(F.lit("ref").alias("system"), F.col("z_ref").alias("z")),
        F.struct(F.lit("test").alias("system"), F.col("z_test").alias("z")))).alias("s")
    long = labelled.select("class", "y", systems).select("class", "y", "s.system", "s.z")
    each = auroc(long, ["class", "system"], "z", "y")
    wide = each.groupBy("class").agg(
        F.max(F.when(F.col("system") == "ref", F.col("auroc"))).alias("auroc_ref"),
        F.max(F.when(F.col("system") == "test", F.col("auroc"))).alias("auroc_test"),
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    return wide.withColumn("retention", ratio("auroc_test", "auroc_ref"))


def macro_retention(per_class: DataFrame) -> DataFrame:
    """Means over the classes defined in both systems, and their ratio."""
    both = per_class.filter(F.col("auroc_ref").isNotNull() & F.col("auroc_test").isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n_classes"), F.avg("auroc_ref").alias("macro_ref"),
                    F.avg("auroc_test").alias("macro_test")
                    ).withColumn("macro_retention", ratio("macro_test", "macro_ref"))


def youden_thresholds(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Threshold that maximises sensitivity + specificity - 1; the highest one on a tie.

    The ROC curve starts at +inf with nothing called positive; NULL for one class only.
    """
    ladder = score_ladder(df, keys, score, positive, descending=True)
    tpr = ratio("cum_pos", "cum_pos_total")
    fpr = ratio("cum_neg", "cum_neg_total")
    out = ladder.groupBy(*keys).agg(
        F.max(F.struct((tpr - fpr).alias("j"), "score")).alias("best"),
        F.max("cum_pos_total").alias("n_pos"), F.max("cum_neg_total").alias("n_neg"))
    defined = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(*keys, "n_pos", "n_neg", F.when(
        defined, F.when(F.col("best.j") > 0, F.col("best.score")).otherwise(F.lit(float("inf")))).alias("threshold"))


def sensitivity_specificity(decided: DataFrame, keys: Sequence[str], decision: str, positive: str) -> DataFrame:
    y, d = F.col(positive).cast("int") == 1, F.col(decision)
    out = decided.groupBy(*keys).agg(
        count_where(y & d).alias("tp"), count_where(~y & d).alias("fp"),
        count_where(y & ~d).alias("fn"), count_where(~y & ~d).alias("tn"))
    return out.withColumn("sensitivity", ratio("tp", F.col("tp") + F.col("fn"))).withColumn(
        "specificity", ratio("tn", F.col("tn") + F.col("fp")))


def margin_summary(per_record: DataFrame, margin: str = "min_margin_ref",
                   cuts: Sequence[float] = CUTS) -> DataFrame:
    """Quartiles of the smallest margins and the share of records below each cut."""
    kept = per_record.filter(finite(margin))
    plain = kept.agg(F.count(F.lit(1)).alias("n"), *[
        F.avg((F.col(margin) < cut).cast("double")).alias(f"frac_lt_{cut:g}".replace(".", "_")) for cut in cuts])
    q = exact_quantiles(kept, [], {"m": margin}, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return beside(plain, q).withColumnsRenamed({
        "m_q25": "q25_min_margin", "m_median": "median_min_margin", "m_q75": "q75_min_margin"})


def class_confusion(labels: DataFrame, outputs: DataFrame, instances: DataFrame, instance: str,
                    name: str) -> DataFrame:
    """One-vs-rest confusion counts and F per class; classes are those that occur in `labels`."""
    a = labels.select(instance, name).distinct().withColumn("_l", F.lit(True))
    b = outputs.select(instance, name).distinct().withColumn("_o", F.lit(True))
    total = instances.select(instance).distinct().agg(F.count(F.lit(1)).alias("_n"))
    lab, out = F.col("_l").isNotNull(), F.col("_o").isNotNull()
    counts = a.join(b, [instance, name], "full_outer").groupBy(name).agg(
        count_where(lab & out).alias("tp"), count_where(~lab & out).alias("fp"), count_where(lab & ~out).alias("fn"))
    counts = counts.filter(F.col("tp") + F.col("fn") > 0)
    counts = beside(counts, total)
    tp2 = 2 * F.col("tp")
    return counts.select(
        name, "tp", "fp", "fn", (F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"),
        ratio(tp2, tp2 + F.col("fp") + F.col("fn")).alias("f_measure"))


def one_hot(df: DataFrame, key: str, value: str, classes: Sequence[str]) -> DataFrame:
    """One boolean column per class of a given class list."""
    return df.groupBy(key).agg(*[
        F.coalesce(F.bool_or(F.col(value) == c), F.lit(False)).alias(str(c)) for c in classes])


def flips_per_bin(df: DataFrame, value: str, flip: str, group: str, weight: str, edges: Sequence[float]) -> DataFrame:
    """Rows, distinct groups and flips per left-closed bin [lo, hi); empty bins are kept."""
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    index = F.size(F.filter(bounds, lambda e: e <= F.col(value))) - 1
    counted = df.filter(finite(value)).groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"),
        count_where(F.col(flip)).alias("n_flips"), F.avg(weight).alias("mean_abs_dp"))
    bins = df.sparkSession.createDataFrame(
        [(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)],
        "bin int, bin_lo double, bin_hi double")
    zero = F.lit(0).cast("bigint")
    return bins.join(counted, "bin", "left").select(
        "bin_lo", "bin_hi", F.coalesce("n_rows", zero).alias("n_rows"), F.coalesce("n_groups", zero).alias("n_groups"),
        F.coalesce("n_flips", zero).alias("n_flips"), ratio("n_flips", "n_rows").alias("record_flip_rate"),
        "mean_abs_dp")


def equal_weights(df: DataFrame, group: str) -> DataFrame:
    """Row weights under which every group weighs the same, with mean 1."""
    per_group = df.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"))
    totals = per_group.agg(F.sum("_rows").alias("_all"), F.count(F.lit(1)).alias("_groups"))
    factor = beside(per_group, totals).select(
        group, (F.col("_all") / (F.col("_rows") * F.col("_groups").cast("double"))).alias("weight"), "_rows")
    return attach(df, factor, [group])


def auroc_pair_p(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Two-sided rank-sum test of a score between two groups (normal form with tie correction)."""
    ladder = score_ladder(df, [], score, positive, descending=False)
    tied = (F.col("pos") + F.col("neg")).cast("double")
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / F.lit(2.0)
    s = ladder.agg(F.sum(F.col("pos") * below).alias("u"), F.sum(tied * tied * tied - tied).alias("ties"),
                   F.max("cum_pos_total").cast("double").alias("n1"), F.max("cum_neg_total").cast("double").alias("n2"))
    n = F.col("n1") + F.col("n2")
    var = F.col("n1") * F.col("n2") / 12.0 * ((n + 1) - F.col("ties") / F.when(n > 1, n * (n - 1)))
    mean = F.col("n1") * F.col("n2") / 2.0
    high = F.greatest(F.col("u"), F.col("n1") * F.col("n2") - F.col("u"))
    return s.select("u", F.when(var > 0, (high - mean - 0.5) / F.sqrt(var)).alias("z"))


def rename_classes(df: DataFrame, mapping: Mapping[str, str], name: str = "class") -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(name)), F.col(name)))
