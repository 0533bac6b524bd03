"""Signals as the classifier sees them and the figures of a condition, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from strandscope.operators import fidelity
from strandscope.plans import jobs

LOGITS = "condition string, record long, class string, thr double, thr_full double, z_ref double, z_test double, y int"


def test_prepared_snr_without_change_of_rate(spark):
    ref = [("a", t, math.sin(t) if 3 <= t < 17 else None) for t in range(20)] + [("b", t, 1.0) for t in range(20)] + [("c", t, None) for t in range(20)]
    test = [("a", t, 0.9 * math.sin(t)) for t in range(20)]
    schema = "record string, t int, mv double"
    rows = {r.record: r for r in fidelity.prepared_snr(spark.createDataFrame(ref, schema), spark.createDataFrame(test, schema), ["record"], 100, 100, 18).collect()}
    assert rows["a"].n_window == 14 and rows["a"].snr == pytest.approx(20, abs=1e-4)
    assert rows["b"].n_window == 18 and rows["b"].snr == pytest.approx(0)  # never read: zeros
    assert set(rows) == {"a", "b"}  # a reference without a sample has no window


def test_prepared_snr_removes_errors_above_the_band(spark):
    t = range(1000)
    slow = [math.sin(2 * math.pi * 2 * i / 500) for i in t]
    schema = "record int, t int, mv double"
    ref = spark.createDataFrame([(1, i, slow[i]) for i in t], schema)
    fast = spark.createDataFrame([(1, i, slow[i] + 0.3 * math.sin(2 * math.pi * 200 * i / 500)) for i in t], schema)
    assert fidelity.prepared_snr(ref, fast, ["record"], 500).first().snr > 30


def test_window_losses(spark):
    schema = "record string, t int, mv double"
    truth = spark.createDataFrame([("a", t, 1.0 if t < 4 else None) for t in range(6)] + [("b", 0, 1.0)], schema)
    read = spark.createDataFrame([("a", 0, 1.0), ("a", 1, float("nan")), ("a", 5, 2.0), ("z", 0, 1.0)], schema)
    rows = {r.record: (r.n_window, r.n_nan, r.missing) for r in fidelity.window_losses(truth, read, ["record"]).collect()}
    assert rows == {"a": (4, 3, False), "b": (1, 1, True)}


def test_condition_table(spark):
    z = [(-1.0, -0.5), (0.4, -0.2), (1.0, 2.0), (0.2, 0.3), (-0.3, 0.6), (0.9, 0.8)]
    rows = [("x", i, c, 0.0, 0.25, a, b, None if i == 5 else int(a > 0 and i != 3)) for i, (a, b) in enumerate(z) for c in "PQ"]
    rows += [("y", i, "P", 0.0, 0.25, 1.0, 1.0, None) for i in range(3)]
    losses = spark.createDataFrame([("x", 10, 2, False), ("x", 10, 10, True), ("x", 10, 3, False)], "condition string, n_window long, n_nan long, missing boolean")
    evaluation = spark.createDataFrame([("x", 10.0, False), ("x", 20.0, False), ("x", 99.0, True), ("x", float("inf"), False)], "condition string, snr_raw double, missing boolean")
    out = {r.condition: r for r in fidelity.condition_table(spark.createDataFrame(rows, LOGITS), ["P", "Q"], losses, evaluation).collect()}
    x, y = out["x"], out["y"]
    assert (x.n_records, x.n_flips, x.n_record_flips) == (6, 4, 2)
    assert x.flip_rate == pytest.approx(2 / 6) and x.record_flip_rate == pytest.approx(2 / 6)
    po, pa, pb = 4 / 6, 4 / 6, 4 / 6
    pe = pa * pb + (1 - pa) * (1 - pb)
    assert x.kappa == pytest.approx((po - pe) / (1 - pe)) == pytest.approx(x.kappa_P)
    full = [(a > 0.25, b > 0.25) for a, b in z]
    assert x.flip_rate_thrfull == pytest.approx(sum(a != b for a, b in full) / 6)
    labelled = [(a, b, int(a > 0 and i != 3)) for i, (a, b) in enumerate(z) if i != 5]

    def area(k):
        pos, neg = [r[k] for r in labelled if r[2]], [r[k] for r in labelled if not r[2]]
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))

    assert (x.auroc_ref_macro, x.auroc_test_macro) == (pytest.approx(area(0)), pytest.approx(area(1)))
    assert x.ret_P == pytest.approx(area(1) / area(0)) and x.npos_Q == 2
    assert x.interior_nan_frac == pytest.approx(5 / 20) and x.missing_leads == 1 and x.snr_median_db == pytest.approx(15)
    assert (y.kappa, y.n_flips, y.kappa_Q, y.auroc_ref_macro, y.interior_nan_frac, y.snr_median_db) == (1.0, 0, None, None, None, None)


def test_condition_table_of_nothing(spark):
    assert fidelity.condition_table(spark.createDataFrame([], LOGITS), ["P"]).count() == 0


def test_condition_job(spark):
    """A faithful reading changes nothing; a lost record is read as zeros; a record whose original differs is refused."""
    def wave(r, lead, t):
        return math.sin((r + 1) * (t + 1) / 9.0) + (0.5 if lead == "II" else 0.0) + r / 4

    samples = [(r, lead, t, wave(r, lead, t)) for r in range(4) for lead in ("I", "II") for t in range(40)]
    schema = "record int, lead string, t int, mv double"
    original = spark.createDataFrame([(r, lead, t, v + (0.5 if r == 3 else 0.0)) for r, lead, t, v in samples], schema)
    truth = spark.createDataFrame([(r, lead, t, v if t < 20 or lead == "II" else None) for r, lead, t, v in samples], schema)
    read = spark.createDataFrame([s for s in samples if s[0] != 2], schema)
    thresholds = spark.createDataFrame([("P", 0.1, 0.2), ("Q", 0.3, 0.2)], "class string, thr double, thr_full double")

    def score(prepared):
        mean = prepared.groupBy("record", "kind").agg(F.avg("y").alias("m"))
        return mean.select("record", "kind", F.inline(F.array(F.struct(F.lit("P").alias("class"), F.col("m").alias("z")), F.struct(F.lit("Q").alias("class"), (F.col("m") * 2).alias("z")))))

    out = jobs.condition_job("clean", truth, original, read, score, thresholds, ["P", "Q"], fs=100.0)
    row = out["table"].first()
    assert {r.record: r.reason for r in out["checked"].collect() if r.reason} == {3: "deviates"}
    assert (row.condition, row.n_records, row.missing_leads) == ("clean", 3, 2)
    z = {(r.record, r["class"]): (r.z_ref, r.z_test) for r in out["logits"].collect()}
    assert all(a == pytest.approx(b) for (r, _), (a, b) in z.items() if r != 2)
    assert z[2, "P"][1] == 0 and row.interior_nan_frac == 0
    assert row.n_flips == sum((a > t) != (b > t) for (_, c), (a, b) in z.items() for t in [{"P": 0.1, "Q": 0.3}[c]])
    assert out["snr"].filter("record = 2").agg(F.max(F.abs("snr"))).first()[0] == pytest.approx(0)
