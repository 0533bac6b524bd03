import numpy as np
import pandas as pd
import pytest

from strandscope.operators import metrics, pairing

NAN, INF = float("nan"), float("inf")


def long(spark, **signals):
    rows = [(k, "I", t, float(v)) for k, x in signals.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "record string, lead string, t int, mv double")


def test_snr_rules(spark):
    ref = long(spark, clean=[1, -1, 1, -1], gaps=[2, 2, 2, 2], silent=[0, 0], far=[1, 1], short=[1, 1, 1, 1])
    est = long(spark, clean=[1, -1, 1, -1], gaps=[1, NAN, 1, INF], silent=[1, 1], far=[11, 11], short=[0, 0])
    got = {r["record"]: r for r in metrics.signal_snr(metrics.sample_pairs(ref, est, ["record"]), ["record"]).collect()}
    assert got["clean"]["snr"] == INF
    assert got["gaps"]["snr"] == pytest.approx(0.5 * 10 * np.log10(4))
    assert got["silent"]["snr"] is None
    assert got["far"]["snr"] == pytest.approx(-20)
    assert got["short"]["snr"] == pytest.approx(0.0) and got["short"]["n_both"] == 2


def test_noise_lowers_the_snr(spark):
    rng = np.random.default_rng(0)
    x = np.sin(2 * np.pi * 5 * np.arange(1000) / 500)
    ref = {f"s{i}": x for i in range(4)}
    est = {f"s{i}": x + rng.normal(0, s, 1000) for i, s in enumerate((0.01, 0.05, 0.1, 0.5))}
    pairs = metrics.sample_pairs(long(spark, **ref), long(spark, **est), ["record"])
    got = [r["snr"] for r in metrics.signal_snr(pairs, ["record"]).orderBy("record").collect()]
    assert got == sorted(got, reverse=True) and got[0] > 35


def brute_alignment(ref, est, reach):
    best = (None, 0, None)
    for s in range(-min(reach, len(ref) - 1), min(reach, len(ref) - 1) + 1):
        pairs = [(ref[i], est[i + s]) for i in range(len(ref)) if 0 <= i + s < len(ref)]
        n_ref = sum(np.isfinite(a) for a, _ in pairs)
        both = np.array([p for p in pairs if np.isfinite(p).all()])
        if len(both) < 2:
            continue
        off = np.median(both[:, 1] - both[:, 0])
        noise = np.mean((both[:, 1] - off - both[:, 0]) ** 2)
        snr = INF if noise == 0 else 10 * np.log10(np.mean(both[:, 0] ** 2) / noise) * len(both) / n_ref
        if best[0] is None or snr > best[0]:
            best = (snr, s, off)
    return best


@pytest.mark.parametrize("cells", [10**6, 100], ids=["at once", "in parts"])
def test_alignment_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(metrics, "SHIFT_CELLS", cells)
    rng = np.random.default_rng(1)
    signals, estimates, want = {}, {}, {}
    for i, s in enumerate((-3, 0, 2)):
        x = np.cumsum(rng.normal(size=60))
        y = np.roll(x, s) + 0.5 + rng.normal(0, 0.1, 60)
        y[10:13] = NAN
        signals[f"r{i}"], estimates[f"r{i}"] = x, y
        want[f"r{i}"] = brute_alignment(x, y, 5)
    pairs = metrics.sample_pairs(long(spark, **signals), long(spark, **estimates), ["record"])
    for r in metrics.aligned_snr(pairs, ["record"], max_shift=5).collect():
        snr, shift, off = want[r["record"]]
        assert (r["shift"], r["snr_aligned"], r["offset"]) == (shift, pytest.approx(snr), pytest.approx(off))


def test_evaluation_rows(spark):
    x = np.sin(np.arange(40) / 3)
    gt = np.full(100, NAN)
    gt[30:70] = x
    ref = long(spark, window=gt, start=gt, empty=np.full(5, NAN), lost=gt)
    at_start = np.full(100, NAN)
    at_start[:40] = x + 0.01
    est = long(spark, window=np.where(np.isfinite(gt), gt + 0.01, NAN), start=at_start, empty=x)
    got = {r["record"]: r for r in metrics.evaluate_signals(ref, est, max_shift=2).collect()}
    assert got["window"]["placement"] == "window" and got["start"]["placement"] == "start"
    assert got["start"]["window_start"] == 30 and got["start"]["window_end"] == 70 and got["start"]["n_samples"] == 40
    assert got["start"]["pearson_r"] == pytest.approx(1) and got["start"]["offset"] == pytest.approx(0.01)
    for lost in ("empty", "lost"):
        assert got[lost]["missing"] and got[lost]["placement"] == "" and got[lost]["snr_raw"] is None
    assert got["empty"]["window_start"] == -1 and got["lost"]["window_start"] == 30


def test_cumulative_and_signed_metrics(spark):
    ref, est = np.array([1.0, -2, 3, 0, 4]), np.array([1.0, -1, 3.02, 0, 2])
    pairs = metrics.sample_pairs(long(spark, r=ref), long(spark, r=est), ["record"])
    a, b = np.cumsum(abs(ref)), np.cumsum(abs(est))
    assert metrics.cumulative_distance(pairs, ["record"], grid=2).first()["ks"] == pytest.approx(1 - max(abs(a / a[-1] - b / b[-1])))
    hit = np.where(abs(ref - est) <= 0.05 * ref.std(), 1, -1).mean()
    assert metrics.signed_correlation_index(pairs, ["record"]).first()["asci"] == pytest.approx(hit)
    with pytest.raises(ValueError):
        metrics.signed_correlation_index(pairs, ["record"], beta=0)


def test_pairing_drops_what_cannot_be_compared(spark):
    schema = "record string, lead string, snr_raw string, missing boolean"
    a = spark.createDataFrame([("r1", "I", "10.0", None), ("r1", "II", "nan", False), ("r2", "I", "5", True), ("r3", "I", "7", False),
                               ("r4", "I", "x", False)], schema)
    b = spark.createDataFrame([("r1", "I", "12.5", False), ("r1", "II", "1", False), ("r2", "I", "5", False), ("r3", "I", "Infinity", False),
                               ("r4", "I", "3", False)], schema)
    assert [tuple(r) for r in pairing.pair_runs(a, b).collect()] == [("r1", "I", 10.0, 12.5, 2.5)]
    with pytest.raises(ValueError):
        pairing.pair_runs(a, b, "pearson_r")


def test_prefix_match_prefers_the_exact_name(spark):
    gt = spark.createDataFrame([("a",), ("b",), ("c-1",), ("d",)], "record string")
    pred = spark.createDataFrame([("a-0",), ("a",), ("b-2",), ("b-10",), ("c-1-x",), ("dd-1",)], "p string")
    got = {r["record"]: r["match"] for r in pairing.match_by_prefix(gt, pred, "record", "p").collect()}
    assert got == {"a": "a", "b": "b-10", "c-1": "c-1-x"}


def test_run_summary_has_a_grand_total(spark):
    pdf = pd.DataFrame({"record": ["a", "a", "b"], "snr_raw": [1.0, NAN, 5.0], "missing": [False, False, True]})
    got = {r["record"]: r for r in pairing.run_summary(spark.createDataFrame(pdf)).collect()}
    assert (got["a"]["n_leads"], got["a"]["snr_raw_median"]) == (2, 1.0)
    assert (got["b"]["n_missing"], got["b"]["snr_raw_median"]) == (1, None)
    assert (got["*"]["n_leads"], got["*"]["snr_raw_mean"]) == (2, 1.0)
