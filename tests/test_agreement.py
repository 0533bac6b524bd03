import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandscope.functions import digests
from strandscope.functions.statistics import exact_interval
from strandscope.operators import agreement, labels, resampling

NAN = float("nan")


def md5_picks(seed, n_boot, n):
    """Cluster of every slot of every draw, from the digest of seed, draw and slot."""
    share = lambda d, s: int(hashlib.md5(f"{seed}:{d}:{s}".encode()).hexdigest()[:12], 16) / 2**48
    return np.array([[int(share(d, s) * n) for s in range(n)] for d in range(n_boot)])


def test_decisions_are_strict_and_false_on_nan(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.1, 1.0), (NAN, 1.0), (1.0, NAN), (None, 1.0)], "z double, t double")
    assert [r[0] for r in df.select(agreement.decide("z", "t")).collect()] == [False, True, False, False, False]


def test_kappa_of_constant_raters_is_one(spark):
    df = spark.range(1).select(
        agreement.kappa(F.lit(4.0), F.lit(4.0), F.lit(4.0), F.lit(4.0)).alias("same"),
        agreement.kappa(F.lit(4.0), F.lit(2.0), F.lit(2.0), F.lit(2.0)).alias("chance"))
    assert df.first()["same"] == 1.0 and df.first()["chance"] == 0.0


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_auroc_and_threshold_equal_brute_force(spread):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), np.round(rng.normal(size=300), 1)
    pdf = pd.DataFrame({"c": "a", "y": y, "s": s})
    both = pd.concat([pdf, pd.DataFrame({"c": "b", "y": [1, 1], "s": [0.0, 1.0]})])
    got = {r["c"]: r for r in agreement.auroc(spread.createDataFrame(both), ["c"], "s", "y").collect()}
    assert got["a"]["auroc"] == pytest.approx(brute_auroc(y, s)) and got["b"]["auroc"] is None
    cuts = {t: np.mean(s[y == 1] >= t) - np.mean(s[y == 0] >= t) for t in np.unique(s)}
    best = max(cuts.values())
    want = max(t for t, j in cuts.items() if j == best)
    got = {r["c"]: r["threshold"] for r in agreement.youden_thresholds(spread.createDataFrame(both), ["c"], "s", "y").collect()}
    assert got["a"] == pytest.approx(want) and got["b"] is None


def test_useless_score_has_an_infinite_threshold(spark):
    df = spark.createDataFrame([("a", 1, 0.0), ("a", 0, 1.0)], "c string, y int, s double")
    assert agreement.youden_thresholds(df, ["c"], "s", "y").first()["threshold"] == math.inf


def test_bins_are_left_closed_and_kept_when_empty(spark):
    df = spark.createDataFrame([(8.0, True, 1, 0.1), (9.9, False, 1, 0.3), (10.0, True, 2, 0.2), (NAN, True, 3, 0.1)],
                               "snr double, flip boolean, id int, dp double")
    rows = agreement.flips_per_bin(df, "snr", "flip", "id", "dp", (-math.inf, 8.0, 10.0, math.inf)).orderBy("bin_lo").collect()
    assert [(r["n_rows"], r["n_groups"], r["n_flips"]) for r in rows] == [(0, 0, 0), (2, 1, 1), (1, 1, 1)]


def test_exact_interval_known_values():
    assert exact_interval(0, 10) == (0.0, pytest.approx(1 - 0.025 ** 0.1))
    assert exact_interval(10, 10) == (pytest.approx(0.025 ** 0.1), 1.0)
    low, high = exact_interval(3, 20)
    assert (low, high) == (pytest.approx(0.0320709, abs=1e-6), pytest.approx(0.3789268, abs=1e-6))
    assert math.isnan(exact_interval(0, 0)[0])


def test_cluster_draws_follow_the_digest(spark):
    got = resampling.cluster_picks(spark, 7, 20, 5).toPandas().groupby("draw").apply(
        lambda g: np.repeat(g["cluster"], g["times"]).tolist(), include_groups=False)
    want = md5_picks(5, 20, 7)
    assert [sorted(row) for row in want.tolist()] == [sorted(got[i]) for i in range(20)]


def test_bootstrap_median_equals_numpy(spread):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"record": rng.choice(list("abcdef"), 80, p=[.5, .1, .1, .1, .1, .1]), "delta": rng.normal(size=80)})
    got = resampling.bootstrap_median(spread.createDataFrame(pdf), "record", "delta", n_boot=60, seed=2).first()
    groups = [g["delta"].to_numpy() for _, g in pdf.groupby("record", sort=True)]
    draws = md5_picks(2, 60, len(groups))
    medians = [np.median(np.concatenate([groups[j] for j in row])) for row in draws]
    assert got["median"] == pytest.approx(np.median(pdf["delta"]))
    assert (got["lo"], got["hi"]) == (pytest.approx(np.percentile(medians, 2.5)), pytest.approx(np.percentile(medians, 97.5)))


def test_salted_clusters_give_the_same_interval(spread, monkeypatch):
    pdf = pd.DataFrame({"record": ["a"] * 30 + ["b"] * 5, "delta": np.arange(35.0)})
    df = spread.createDataFrame(pdf)
    plain = resampling.bootstrap_median(df, "record", "delta", 30).first()
    monkeypatch.setattr(resampling, "ROWS_PER_SALT", 4)
    assert resampling.bootstrap_median(df, "record", "delta", 30).first() == plain


def test_draws_are_even(spark):
    got = resampling.cluster_picks(spark, 25, 400, 1)
    assert {r["n"] for r in got.groupBy("draw").agg(F.sum("times").alias("n")).collect()} == {25}
    each = [r["n"] for r in got.groupBy("cluster").agg(F.sum("times").alias("n")).collect()]
    assert len(each) == 25 and 300 < min(each) and max(each) < 500


def test_logistic_fit_and_its_degenerate_forms(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(15, 5, 4000)
    flip = rng.random(4000) < 1 / (1 + np.exp(-(3 - 0.4 * x)))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "flip": flip, "g": rng.integers(0, 50, 4000)}))
    fit = resampling.logistic_fit(df, "x", "flip", "g").first()
    assert fit["converged"] and fit["intercept"] == pytest.approx(3, abs=0.4) and fit["slope"] == pytest.approx(-0.4, abs=0.04)
    p = 1 / (1 + np.exp(-(fit["intercept"] + fit["slope"] * x)))
    assert abs(np.sum(flip - p)) < 1e-6 and abs(np.sum((flip - p) * x)) < 1e-5
    assert fit["x_at_p0_1"] == pytest.approx((math.log(1 / 9) - fit["intercept"]) / fit["slope"])
    cases = {"no flips": [(1.0, False, 1), (2.0, False, 1)], "separated": [(1.0, True, 1), (2.0, False, 1)],
             "constant x": [(1.0, True, 1), (1.0, False, 2)], "no rows": [(NAN, True, 1)], "all rows flip": [(1.0, True, 1)]}
    for why, rows in cases.items():
        df = spark.createDataFrame(rows, "x double, flip boolean, g int")
        assert resampling.logistic_fit(df, "x", "flip", "g").first()["fit"] == f"degenerate: {why}"


def test_folds_follow_the_digest(spark):
    got = labels.crossval_folds(spark.range(23).withColumnRenamed("id", "k"), "k", seed=12345).toPandas().set_index("k")["fold"]
    order = sorted(range(23), key=lambda k: hashlib.md5(f"12345:{k}".encode()).hexdigest())
    want = dict(zip(order, np.repeat(np.arange(5), [5, 5, 5, 4, 4])))
    assert got.to_dict() == want


def test_duplicate_case_across_folds_is_an_error(spark):
    a = spark.createDataFrame([("x",)], "case string")
    with pytest.raises(ValueError):
        labels.accumulated([a, a], "case")


def test_interval_of_decisions_equals_numpy(spread):
    rng = np.random.default_rng(6)
    n = 40
    rows = [(f"r{i:02d}", i // 2, c, float(a), float(a + rng.normal(0, 0.5)), 0.0, o) for i in range(n)
            for o, c in enumerate("xyz") for a in [rng.normal()]]
    df = spread.createDataFrame(rows, "record string, patient int, class string, z_ref double, z_test double, thr double, class_order int")
    got = resampling.decision_intervals(agreement.with_decisions(df), n_boot=100, seed=3, cluster="patient").first()
    ref = np.array([r[3] > 0 for r in rows]).reshape(n, 3)
    test = np.array([r[4] > 0 for r in rows]).reshape(n, 3)
    picks = md5_picks(3, 100, n // 2)

    def stats(idx):
        a, b = ref[idx], test[idx]
        pe = a.mean() * b.mean() + (1 - a.mean()) * (1 - b.mean())
        return (np.mean(a == b) - pe) / (1 - pe), np.mean((a != b).any(axis=1))

    draws = np.array([stats(np.concatenate([[2 * p, 2 * p + 1] for p in row])) for row in picks])
    assert got["kappa"] == pytest.approx(stats(np.arange(n))[0]) and got["n_records"] == n
    assert (got["kappa_lo"], got["kappa_hi"]) == tuple(pytest.approx(v) for v in np.percentile(draws[:, 0], [2.5, 97.5]))
    assert (got["record_flip_rate_lo"], got["record_flip_rate_hi"]) == tuple(pytest.approx(v) for v in np.percentile(draws[:, 1], [2.5, 97.5]))
    same = agreement.with_decisions(df.withColumn("z_test", F.col("z_ref")))
    none = resampling.decision_intervals(same, n_boot=20).first()
    assert none["degenerate"] and none["kappa"] == 1.0 and none["kappa_lo"] is None and none["record_flip_exact_hi"] > 0


def test_resampled_auroc_equals_numpy(spread):
    rng = np.random.default_rng(8)
    y, s = rng.integers(0, 2, 40), np.round(rng.normal(size=40), 1)
    df = spread.createDataFrame(pd.DataFrame({"record": np.arange(40), "c": "a", "y": y, "s": s}))
    got = resampling.bootstrap_auroc(df, "record", ["c"], "s", "y", n_boot=15, seed=9).orderBy("draw").toPandas()["auroc"]
    picks = md5_picks(9, 15, 40)
    assert np.allclose(got, [brute_auroc(y[i], s[i]) for i in picks])


def test_price_delta_draws_as_often_as_the_operator_does(monkeypatch):
    from inspect import signature

    from strandscope.plans import catalogue, decision_queries

    seen = {}
    monkeypatch.setattr(decision_queries, "_runs", lambda *a: (None, None))
    monkeypatch.setattr(decision_queries.pairing, "pair_runs", lambda *a: None)
    monkeypatch.setattr(decision_queries, "rounded", lambda df, *a: df)
    usual = signature(resampling.bootstrap_median).parameters["n_boot"].default
    monkeypatch.setattr(resampling, "bootstrap_median", lambda *a, n_boot=usual, **k: seen.update(n_boot=n_boot))
    catalogue.QUERIES["bootstrap_price_delta"](None, "")
    assert seen["n_boot"] == usual == 2000 and "range(2000)" in catalogue.ORACLES["bootstrap_price_delta"]


def test_many_digests_are_those_of_one():
    for prefix in ("0:7:", "-12:1999:", "x" * 51, "x" * 70):
        for start, stop in ((0, 1200), (9_995, 10_004), (99_998, 100_003), (24_999_998, 25_000_003)):
            want = [float(int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:12], 16)) for i in range(start, stop)]
            assert np.concatenate(list(digests.md5_heads(prefix, start, stop))).tolist() == want


@pytest.mark.parametrize("change", [{}, {"BAND_SIGMAS": 0.01}, {"BAND_CELLS": 1}, {"BLOCK": 4, "HELD": 8}, {"PICKS_PER_GROUP": 40}])
def test_middles_of_draws_in_and_beyond_the_band(spark, monkeypatch, change):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 30, 500), rng.normal(size=500).round(1), strict=True)]
    rows += [(0, 5.0)] * 300 + [(3, None), (40, None), (41, float("nan"))]  # a cluster with a value that comes often, two without any
    for name, value in change.items():
        monkeypatch.setattr(resampling, name, value)
    got = resampling.bootstrap_median(spark.createDataFrame(rows, "record int, delta double"), "record", "delta", n_boot=25, seed=4).first()
    of = [[v for r, v in rows if r == k and v is not None and v == v] for k in sorted({r for r, _ in rows})]
    medians = [np.median(np.concatenate([of[j] for j in row])) for row in md5_picks(4, 25, len(of))]
    assert got["median"] == np.median(np.concatenate(of)) and got["n_clusters"] == 32 and got["n_rows"] == 801
    assert np.allclose([got["lo"], got["hi"]], np.quantile(medians, [0.025, 0.975]))
