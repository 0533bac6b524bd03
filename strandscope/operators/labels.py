"""Diagnostic labels, folds, held-out groups, caches keyed by content."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pinned
from .ordered import numbered

# Acute infarction statement numbers.
TRAIN_FOLDS, VALIDATION_FOLD, TEST_FOLD = (1, 2, 3, 4, 5, 6, 7, 8), 9, 10  # fixed values


def superclasses(codes: DataFrame, statements: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Distinct classes of the diagnostic codes of each key, by name or by first appearance.

    `codes` has one row per (key, code); `statements` maps diagnostic codes to a class.
    There are only a handful of classes, so the collected list is short.
    """
    known = statements.filter((F.col("diagnostic") == 1) & F.col("diagnostic_class").isNotNull()).select(
        "code", "diagnostic_class")
    hits = codes.join(known, "code")
    if order is None:
        return hits.groupBy(key).agg(F.array_sort(F.collect_set("diagnostic_class")).alias("classes"))
    first = hits.groupBy(key, "diagnostic_class").agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_o", "diagnostic_class"))), lambda s: s["diagnostic_class"]).alias("classes"))


def class_columns(labelled: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One 0/1 column per class."""
    return labelled.withColumns({
        c: F.coalesce(F.array_contains("classes", c), F.lit(False)).cast("int") for c in classes})


def diagnosis_labels(classes: Column, codes: Column, statements: Column, acute: Sequence[str]) -> Column:
    """The label list of a record as text, rules in fixed order.

    `statements` is text: an acute acronym counts wherever it occurs in it.
    """
    has = lambda c: F.coalesce(F.array_contains(classes, c), F.lit(False))
    code = lambda *cs: _any([F.coalesce(F.array_contains(codes, c), F.lit(False)) for c in cs])
    fresh = _any([F.coalesce(F.contains(statements, F.lit(a)), F.lit(False)) for a in acute])
    rules = [
        ("NORM", has("NORM")), ("Acute MI", fresh), ("Old MI", has("MI") & ~fresh),
        ("STTC", has("STTC")), ("CD", has("CD")), ("HYP", has("HYP")),
        ("PAC", code("PAC")), ("PVC", code("PVC")), ("AFIB/AFL", code("AFIB", "AFLT")),
        ("TACHY", code("STACH", "SVTAC", "PSVT")), ("BRADY", code("SBRAD")),
    ]
    return F.concat_ws(", ", *[F.when(rule, F.lit(name)) for name, rule in rules])


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def sex_text(code: Column) -> Column:
    return F.when(code == 0, "Male").when(code == 1, "Female").otherwise("Unknown")


def fold_group(fold: Column) -> Column:
    """Training, validation or test group of a fold."""
    return (F.when(fold.isin(*TRAIN_FOLDS), "Tr").when(fold == VALIDATION_FOLD, "Tv").when(fold == TEST_FOLD, "Ts"))


def id_in_path(path: Column) -> Column:
    """Record id in front of '_hr', padded to five digits or longer; it replaces a substring search per id."""
    return F.regexp_extract(path, r"([0-9]{5,})_hr", 1).try_cast("bigint")


def held_out_records(records: DataFrame, held_out: DataFrame, key: str, patient: str) -> DataFrame:
    """Every record of a patient who owns a held-out record."""
    patients = records.join(held_out.select(key), key, "left_semi").select(patient).distinct()
    return records.join(patients, patient, "left_semi").select(key)


def split_records(records: DataFrame, held_out: DataFrame, key: str, patient: str, fold: str, labelled: Column) -> DataFrame:
    """Labelled records with their group; held-out patients leave training and validation only."""
    guard = held_out_records(records, held_out, key, patient).withColumn("_held", F.lit(True))
    rows = records.filter(labelled).withColumn("group", fold_group(F.col(fold))).join(guard, key, "left")
    return rows.filter(F.col("group").isNotNull() & (F.col("_held").isNull() | (F.col("group") == "Ts"))).drop("_held")


def labels_for(ids: DataFrame, db: DataFrame, key: str, classes: Sequence[str], fold: str) -> DataFrame:
    """Labels of given ids in the given order; unknown ids have no label and fold -1."""
    found = ids.join(db.select(key, fold, *classes), key, "left")
    ones = [F.coalesce(F.col(c), F.lit(0)).cast("int") for c in classes]
    total = ones[0]
    for c in ones[1:]:
        total = total + c
    return found.select(*ids.columns, *[o.alias(c) for o, c in zip(ones, classes)], (total > 0).alias("labelled"),
                        F.coalesce(F.col(fold), F.lit(-1)).cast("int").alias(fold))


def cached(inputs: DataFrame, cache: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): an entry counts only while the digest of its input is the same."""
    on = [key, digest]
    return inputs.join(cache, on, "inner"), inputs.join(cache.select(*on), on, "left_anti")


def refreshed(cache: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """Cache with the entries of the computed keys replaced."""
    return cache.join(computed.select(key), key, "left_anti").unionByName(computed)


def replaced(table: DataFrame, new_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop the rows of the keys that come again, then append."""
    return table.join(new_rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(
        new_rows, allowMissingColumns=True)


def crossval_folds(ids: DataFrame, key: str, seed: int = 12345, n_splits: int = 5) -> DataFrame:
    """Validation fold of each id: ids in the order of MD5(seed:id), cut in equal parts."""
    mixed = ids.select(key).distinct().withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")))
    placed = pinned(numbered(mixed, [], ["_h", key]).withColumn("place", F.col("rn") - 1))
    head = placed.select("rn_total").first()
    n = int(head[0]) if head else 0
    base, longer = divmod(n, n_splits)
    cut = longer * (base + 1)
    fold = F.when(F.col("place") < cut, F.floor(F.col("place") / (base + 1))).otherwise(
        F.lit(longer) + F.floor((F.col("place") - cut) / F.lit(max(base, 1))))
    return placed.select(key, fold.cast("int").alias("fold"))


def accumulated(folds: Sequence[DataFrame], key: str) -> DataFrame:
    """Predictions of all folds; a case that occurs in two folds is an error."""
    out = folds[0].withColumn("fold", F.lit(0))
    for i, f in enumerate(folds[1:], 1):
        out = out.unionByName(f.withColumn("fold", F.lit(i)))
    twice = out.groupBy(key).agg(F.countDistinct("fold").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"case {twice[0][key]} occurs in more than one fold")
    return out


def best_configuration(scores: DataFrame, name: str, score: str, order: str) -> DataFrame:
    """Highest score; the first of equals."""
    return scores.agg(F.max(F.struct(score, (-F.col(order)).alias("_o"), name)).alias("b")).select(
        F.col(f"b.{name}").alias(name), F.col(f"b.{score}").alias(score))


def scaled_errors(masked: DataFrame, read: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """The reading error scaled by each alpha: (1 - alpha) x reference + alpha x reading.

    alpha 0 is the reference itself, without the gaps of the reading. The list of alphas
    is short and given by the caller, so rows are repeated in place.
    """
    levels = list(dict.fromkeys(float(a) for a in alphas))
    if not levels or any(not np.isfinite(a) or a < 0 for a in levels):
        raise ValueError("alphas must be finite and at least 0")
    both = masked.select(*keys, F.col("mv").alias("ref")).join(
        read.select(*keys, F.col("mv").alias("est")), list(keys), "left")
    long = both.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in levels])))
    a = F.col("alpha")
    mixed = F.when(a == 0, F.col("ref")).otherwise((1 - a) * F.col("ref") + a * F.col("est"))
    return long.select(*keys, "alpha", "ref", mixed.alias("est"))
