"""Steps whose cost has to follow the input: what their plans may hold, and results on shapes that once broke them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandscope import dims
from strandscope.operators import grid, lines, resampling, robust, signals


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def boxes(spark, names=("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")):
    column = {"I": 0, "II": 0, "III": 0, "aVR": 1, "aVL": 1, "aVF": 1, "V1": 2, "V2": 2, "V3": 2, "V4": 3, "V5": 3, "V6": 3}
    rows = [(7, n, 100.0 + 500 * column[n], 2000.0 if n == "II" else 500.0) for n in names]
    return spark.createDataFrame(rows, "record long, lead string, x1 double, width double")


@pytest.mark.parametrize("fit", [grid.fit_column_grid, grid.rescued_grid])
def test_a_page_is_fitted_where_its_boxes_are(spark, fit):
    heights = spark.createDataFrame([(7, 1728.0), (8, 1728.0)], "record long, height double")
    out = fit(boxes(spark), heights)
    plan = plan_of(out)
    assert "Join" not in plan and "Window" not in plan and "Generate" not in plan
    got = {r["record"]: r for r in out.collect()}
    assert got[7]["reason"] is None and got[7]["long_leads"] == ["II"] and abs(got[7]["g0"] - 100) < 1.0
    assert got[8]["reason"] == grid.NO_BOXES and got[8]["long_leads"] == []


def test_parallel_lines_are_counted_without_frames_of_values(spark):
    rng = np.random.default_rng(5)
    theta = np.round(rng.uniform(-0.2, 0.2, 400), 3)
    df = spark.createDataFrame([(int(i % 2), float(t)) for i, t in enumerate(theta)], "label int, theta double")
    out = grid.parallel_counts(df, ["label"], "theta", 0.05)
    assert "RangeFrame" not in plan_of(out)
    for r in out.collect():
        mine = theta[r["label"]::2]
        assert r["n_parallel"] == int(((mine > r["theta"] - 0.05) & (mine < r["theta"] + 0.05)).sum())
        assert r["n_lines"] == int((mine == r["theta"]).sum())


def bands(spark, n_bands, width=160):
    """Bands of one page with a line every eight pixels."""
    rows = spark.range(n_bands).select(F.lit(1).alias("record"), F.col("id").cast("int").alias("band"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    return rows.withColumn("v", F.when(F.col("col") % 8 == 0, 100.0).otherwise(0.0) + F.col("band") % 3)


def test_spectra_of_a_page_are_added_before_they_leave_a_task(spark):
    sums = lines._summed_power(bands(spark, 300), lambda p: np.abs(np.fft.rfft(p - p.mean(), n=32)) ** 2)
    p = np.array([100.0 if c % 8 == 0 else 0.0 for c in range(160)])
    want = 300 * np.abs(np.fft.rfft(p - p.mean(), n=32)) ** 2
    got = {r["bin"]: r["power"] for r in sums.collect()}
    assert len(got) == 17 and np.allclose([got[b] for b in range(17)], want, rtol=1e-6, atol=1e-6)
    assert "ArrowEvalPython" not in plan_of(lines.grid_period(bands(spark, 300)))
    waves = bands(spark, 300).withColumn("v", F.cos(2 * np.pi * F.col("col") / 8))
    assert abs(lines.grid_period(waves).first()["period"] - 8.0) < 0.05


def test_bands_have_medians_without_an_order_over_all_pixels(spark, monkeypatch):
    px = bands(spark, 6).select("record", F.col("band").alias("row"), "col", F.col("v").alias("darkness"))
    monkeypatch.setattr(lines, "exact_quantiles", None)
    got = lines.band_profiles(px, 3).collect()
    assert len(got) == 2 * 160 and all(r["v"] == (101.0 if r["col"] % 8 == 0 else 1.0) for r in got)


def test_periods_are_tried_on_the_sum_of_the_bands(spark):
    profiles = bands(spark, 5)
    tries = spark.createDataFrame([(1, 7.9), (1, 8.0)], "record int, period double")
    whole = {r["period"]: r for r in lines._page_comb(profiles, tries).collect()}
    for r in lines.comb(profiles, tries).groupBy("period").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).collect():
        assert abs(whole[r["period"]]["re"] - r["re"]) < 1e-6 and abs(whole[r["period"]]["im"] - r["im"]) < 1e-6


def test_noise_of_a_signal_shorter_than_the_filter(spark):
    rows = [(3, 0, t, 1.0 + t) for t in range(5)] + [(4, 0, 0, 2.0)]
    df = spark.createDataFrame(rows, "record long, lead_index int, t int, mv double")
    noisy = signals.add_band_noise(df, "record", "lead_index", [12.0], seed=7, fs=100.0).toPandas()
    for record in (3, 4):
        x = np.array([r[3] for r in rows if r[0] == record])
        y = noisy[noisy.record == record].sort_values("t")["mv"].to_numpy()
        assert y.size == x.size and abs(10 * np.log10((x ** 2).sum() / ((y - x) ** 2).sum()) - 12.0) < 1e-9


def test_drawn_rows_are_added_up_where_they_arise(spark, monkeypatch):
    monkeypatch.setattr(resampling, "_draw_rows", None)
    rng = np.random.default_rng(2)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 9, 400), np.round(rng.normal(size=400) * 100, 1), strict=True)] + [(0, None), (1, float("nan"))]
    got = resampling.bootstrap_median(spark.createDataFrame(rows, "record int, delta double"), "record", "delta", n_boot=8, seed=1).first()
    of = {k: [v for r, v in rows if r == k and v is not None and v == v] for k in range(9)}
    picks = resampling.cluster_picks(spark, 9, 8, 1).toPandas()
    medians = [np.median(np.concatenate([np.repeat(of[p.cluster], p.times) for p in mine.itertuples()])) for _, mine in picks.groupby("draw")]
    assert np.isclose(got["median"], np.median(np.concatenate(list(of.values())))) and got["n_clusters"] == 9 and got["n_rows"] == 401
    assert np.allclose([got["lo"], got["hi"]], np.quantile(medians, [0.025, 0.975]))


def test_pairs_of_points_are_tried_in_arrays(spark):
    rows = [(1, k, float(k), 2.0 * k + (9.0 if k in (3, 7) else 0.01 * (k % 2))) for k in range(12)] + [(2, 0, 1.0, 1.0), (2, 1, 1.0, 5.0), (3, 0, 0.0, 1.0), (3, 1, 1.0, 3.0)]
    out = robust.consensus_line(spark.createDataFrame(rows, "record int, t int, x double, y double"), ["record"], "t", "x", "y", 0.5)
    assert "flatten" not in plan_of(out)
    got = {r["record"]: r for r in out.collect()}
    assert sorted(got) == [1, 3] and (got[1]["n_agree"], got[1]["n"]) == (10, 12) and abs(got[1]["slope"] - 2) < 0.01
    assert np.isclose(got[3]["slope"], 2.0) and np.isclose(got[3]["intercept"], 1.0)


def test_lines_of_many_keys_are_trimmed_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    size = rng.integers(1, 40, 300)
    x = np.concatenate([np.round(rng.normal(size=n) * 9, 2) for n in size])
    y = 2 * x + np.round(rng.normal(size=x.size), 2) + np.where(rng.random(x.size) < 0.1, 60, 0)
    y[5], x[:size[0]], y[:size[0]] = np.inf, 1.0, 2.0

    def alone(px, py):
        if (px == px[0]).all() and (py == py[0]).all():
            return None
        kept = np.ones(px.size, dtype=bool)
        for step in range(4):
            dx, dy = px[kept] - px[kept].mean(), py[kept] - py[kept].mean()
            turn = 0.5 * np.arctan2(2 * (dx * dy).mean(), (dx * dx).mean() - (dy * dy).mean())
            nx, ny = -np.sin(turn), np.cos(turn)
            r = nx * px + ny * py - (nx * px[kept].mean() + ny * py[kept].mean())
            before = r[kept & np.isfinite(r)]
            if not before.size:
                return None
            if step == 3:
                return nx, ny, np.sqrt((before ** 2).mean()), int(kept.sum()), px.size
            middle = np.median(before)
            kept = np.abs(r - middle) <= 3 * max(1.4826 * np.median(np.abs(before - middle)), 0.5)

    calls, fit = [], robust._total_least_squares
    monkeypatch.setattr(robust, "_total_least_squares", lambda *a: calls.append(1) or fit(*a))
    ends = np.cumsum(size)
    with np.errstate(all="ignore"):
        want = {k: alone(x[e - n:e], y[e - n:e]) for k, (e, n) in enumerate(zip(ends, size, strict=True))}
        told = robust._trimmed(x, y, size, 3)
    want = {k: v for k, v in want.items() if v is not None}
    assert len(calls) == 4 and sorted(want) == np.flatnonzero(told["found"]).tolist() and 0 < len(want) < 300
    points = [(int(k), float(a), float(b)) for k, a, b in zip(np.repeat(np.arange(300), size), x, y, strict=True)] + [(7, float("nan"), 1.0), (None, 1.0, 1.0), (8, None, 2.0)]
    monkeypatch.undo()
    got = robust.trimmed_line(spark.createDataFrame(points, "k int, x double, y double"), ["k"], "x", "y").collect()
    assert sorted(r["k"] for r in got) == sorted(want)
    for r in got:
        assert np.allclose([r[c] for c in ("nx", "ny", "rms", "n_kept", "n")], want[r["k"]], atol=1e-9, equal_nan=True)


def test_samples_of_a_page_are_not_sorted(spark, tmp_path):
    from strandscope.plans import page_queries

    rows = [(3 * h + u, u, 24 * u % 7 + h, 1.5 * h) for u in range(3) for h in range(8)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, h int, value double")
    stamp = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)")
    events.select("event_id", "user_id", stamp.alias("ts"), "value").write.parquet(str(tmp_path / "events.parquet"))
    out = page_queries.page_signals(spark, str(tmp_path))
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert {(r["record"], r["lead"]): r["n"] for r in got} == {(u, n): 5000 if n == "II" else 1250 for u in range(3) for n in dims.LEADS} and len(got) == 36
    assert len({(r["record"], r["g0"], r["pitch"], r["baseline_px"], r["warning"]) for r in got}) == 3
