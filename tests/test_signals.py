import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandscope import dims
from strandscope.functions import filters
from strandscope.operators import grid, lines, metrics, signals, windows


def test_low_pass_response():
    sos = filters.butterworth(4, None, 35.0, 500.0)
    w = np.exp(-2j * np.pi * np.array([0.0, 35.0, 200.0]) / 500)
    h = np.prod([(s[0] + s[1] * w + s[2] * w**2) / (1 + s[3] * w + s[4] * w**2) for s in sos], axis=0)
    assert abs(h[0]) == pytest.approx(1) and abs(h[1]) == pytest.approx(np.sqrt(0.5)) and abs(h[2]) < 1e-3
    assert filters.pad_length(sos) == 15


def test_band_pass_response():
    sos = filters.butterworth(4, 0.5, 40.0, 500.0)
    w = np.exp(-2j * np.pi * np.array([0.0, 0.5, 5.0, 40.0]) / 500)
    h = np.prod([(s[0] + s[1] * w + s[2] * w**2) / (1 + s[3] * w + s[4] * w**2) for s in sos], axis=0)
    assert abs(h[0]) < 1e-9 and abs(h[1]) == pytest.approx(np.sqrt(0.5), rel=1e-6)
    assert abs(h[2]) == pytest.approx(1, abs=1e-4) and abs(h[3]) == pytest.approx(np.sqrt(0.5), rel=1e-6)


def plain_filter(sos, x, start):
    """Sample by sample, each section from the steady state of a constant input."""
    y, level = x.copy(), start
    for b0, b1, b2, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * gain) * level
        z1 = (b1 - a1 * gain) * level + z2
        out = np.empty_like(y)
        for i, v in enumerate(y):
            out[i] = b0 * v + z1
            z1 = b1 * v - a1 * out[i] + z2
            z2 = b2 * v - a2 * out[i]
        y, level = out, level * gain
    return y


def test_block_filter_equals_the_recursion():
    x = np.random.default_rng(0).normal(size=333)
    sos = filters.butterworth(4, None, 35.0, 500.0)
    p = filters.pad_length(sos)
    longer = np.r_[2 * x[0] - x[p:0:-1], x, 2 * x[-1] - x[-2:-p - 2:-1]]
    there = plain_filter(sos, longer, longer[0])
    back = plain_filter(sos, there[::-1], there[-1])[::-1]
    assert np.allclose(filters.zero_phase(sos, x), back[p:-p])
    assert np.allclose(filters.zero_phase(sos, np.full(100, 3.0)), 3.0)


def test_spline_is_exact_on_a_cubic():
    t = np.arange(12.0)
    f = lambda v: 0.3 * v**3 - 2 * v**2 + v - 5
    x = np.linspace(0, 11, 57)
    assert np.allclose(filters.spline_values(0.0, f(t), x), f(x))
    assert np.allclose(filters.spline_values(0.0, f(t[:4]), x[x <= 3]), f(x[x <= 3]))


def test_sharpening_leaves_straight_lines_and_short_traces():
    cols = np.arange(100.0)
    x = np.linspace(5, 90, 400)
    assert np.allclose(filters.sharpen(cols, 2 * cols + 1, x, 500.0), 2 * x + 1, atol=1e-6)
    assert np.array_equal(filters.sharpen(cols, cols**2, x[:15], 500.0), np.interp(x[:15], cols, cols**2))


def test_drawn_lag_finds_a_delay():
    x = np.sin(np.arange(80) / 5)
    lag, _ = filters.quantised_lag(x[10:70], x[7:67], 60)
    assert lag == 3


def frame(spark, x, **more):
    pdf = pd.DataFrame({"record": "r", "t": np.arange(len(x)), "mv": x, **more})
    return spark.createDataFrame(pdf)


def test_gaps_are_filled_on_straight_lines(spark):
    x = np.array([np.nan, np.nan, 2, np.nan, np.nan, 8, 9, np.nan])
    got = signals.fill_gaps(frame(spark, x), ["record"], cell=2.0).toPandas().sort_values("t")
    assert got["filled"].tolist() == [2, 2, 2, 4, 6, 8, 9, 9]
    assert got["in_span"].tolist() == [False, False, True, True, True, True, True, False]
    empty = signals.fill_gaps(frame(spark, np.full(3, np.nan)), ["record"]).toPandas()
    assert (empty["filled"] == 0).all() and not empty["in_span"].any()


@pytest.mark.parametrize("chunk", [65536, 35])
@pytest.mark.parametrize("rates", [(500, 100), (5, 2), (2, 3)])
def test_resampling_equals_the_full_sum(spark, chunk, rates):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=131))
    up, down = filters.rate_ratio(*rates)
    taps = filters.resampling_taps(up, down)
    half, n = taps.size // 2, x.size
    slope = (x[-1] - x[0]) / (n - 1)
    want = []
    for k in range(-(-n * up // down)):
        total = 0.0
        for m in range(-half - 5, n + half + 5):
            j = half + k * down - m * up
            if 0 <= j < taps.size:
                total += taps[j] * (x[m] if 0 <= m < n else x[0] + m * slope if m < 0 else x[-1] + (m - n + 1) * slope)
        want.append(total)
    df = frame(spark, x, s=True)
    got = signals.resample(df, ["record"], *rates, value="mv", span="s", chunk=chunk).toPandas().sort_values("t")
    assert np.allclose(got["y"], want) and got["t"].tolist() == list(range(len(want)))


def test_resampling_keeps_lines_and_clears_outside_the_span(spark):
    x = np.arange(200) * 0.5 + 3
    pdf = pd.DataFrame({"record": "r", "t": np.arange(200), "mv": x, "s": np.arange(200) >= 50})
    got = signals.resample(spark.createDataFrame(pdf), ["record"], 500, 100, value="mv", span="s").toPandas().sort_values("t")
    assert got["y"].tolist()[:10] == [0.0] * 10 and np.allclose(got["y"].to_numpy()[10:], x[50::5])


def test_noise_has_exactly_the_asked_snr(spark):
    x = np.sin(np.arange(500) / 7)
    df = spark.createDataFrame(pd.DataFrame({"record": 3, "lead": 1, "t": np.arange(500), "mv": x}))
    noisy = signals.add_band_noise(df, "record", "lead", [float("inf"), 20.0, 10.0])
    pairs = noisy.withColumnRenamed("mv", "est").join(df.withColumnRenamed("mv", "ref"), ["record", "lead", "t"])
    got = {r["snr_db"]: r["snr"] for r in metrics.signal_snr(pairs, ["snr_db"]).collect()}
    assert got[float("inf")] == float("inf") and got[20.0] == pytest.approx(20) and got[10.0] == pytest.approx(10)


def boxes(g0=100.0, pitch=500.0, change=None):
    rows = {lead: (g0 + (0 if lead == "II" else dims.COLUMN[lead]) * pitch, 4 * pitch if lead == "II" else pitch) for lead in dims.LEADS}
    rows.update(change or {})
    return [("p", k, *v) for k, v in rows.items() if v is not None]


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"II": (100.0, 500.0)}, "no_strip"), ({"II": (100.0, 1200.0)}, "short_strip"),
    ({"V4": None, "V5": None, "V6": None}, "bare_column"), ({"V2": (1130.0, 500.0)}, None),
    ({"I": (160.0, 500.0), "III": (160.0, 500.0), "II": (160.0, 1940.0)}, "edges_lost")])
def test_column_grid(spark, change, reason):
    leads = spark.createDataFrame(boxes(change=change), "record string, lead string, x1 double, width double")
    heights = spark.createDataFrame([("p", 1700.0), ("q", 1700.0)], "record string, height double")
    got = {r["record"]: r for r in grid.fit_column_grid(leads, heights).collect()}
    assert got["p"]["reason"] == reason and got["q"]["reason"] == "no_boxes"
    if reason is None:
        assert got["p"]["g0"] == pytest.approx(100) and got["p"]["pitch"] == pytest.approx(500) and got["p"]["long_leads"] == ["II"]


def test_offsets_snap_to_even_and_stay_on_the_page(spark):
    rows = [("r", "II", 0.0, 5000), ("r", "I", 10.0, 1250), ("r", "V1", 125.0, 1250), ("r", "V6", 990.0, 1250), ("s", "V4", 5.0, 1250)]
    df = spark.createDataFrame(rows, "record string, lead string, x1 double, n_samples int")
    got = {(r["record"], r["lead"]): r for r in grid.lead_offsets(df, 0.01 * __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1.0)).collect()}
    assert got["r", "I"]["snapped"] == 0.0 and not got["r", "I"]["suspicious"]
    assert got["r", "V1"]["raw"] == pytest.approx(1.25) and got["r", "V1"]["snapped"] == 0.0
    assert got["r", "V6"]["snapped"] == 7.5 and got["r", "V6"]["suspicious"]
    assert got["s", "V4"]["raw"] is None and got["s", "V4"]["snapped"] == 7.5


def test_rules_of_the_limb_leads(spark):
    x = np.arange(10.0)
    rows = [("r", lead, t, v) for lead, y in {"I": x, "III": x, "II": 2 * x + 0.5}.items() for t, v in enumerate(y)]
    df = spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "record string, lead string, t int, mv double")
    qc = grid.consistency_warning(grid.consistency(df)).first()
    assert qc["einthoven_rms"] == pytest.approx(0.5) and qc["einthoven_rms_demedian"] == pytest.approx(0, abs=1e-7)
    assert qc["einthoven_n"] == 10 and qc["goldberger_n"] == 0 and qc["warning"] is None


def test_interpolation_beyond_the_knots(spark):
    knots = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 5.0), (1, 11.0, 9.0)], "k int, m double, x double")
    probes = spark.createDataFrame([(1, float(m)) for m in (-2, 0, 4, 10.5, 11, 13)], "k int, m double")
    held = grid.interpolate(probes, knots, ["k"], "m", "x", 3.0).orderBy("m").toPandas()["mapped"]
    assert held.tolist() == [0.0, 0.0, 2.0, 7.0, 9.0, 9.0]
    carried = grid.interpolate(probes, knots, ["k"], "m", "x", 3.0, slope=2.0).orderBy("m").toPandas()["mapped"]
    assert carried.tolist() == [-4.0, 0.0, 2.0, 7.0, 9.0, 13.0]


def test_period_and_tilt_of_drawn_lines(spark):
    rows, cols = np.mgrid[0:60, 0:400]
    angle = 0.4
    x = cols - np.tan(np.radians(angle)) * rows
    dark = 100 * np.clip(np.cos(2 * np.pi * x / 8.0), 0, None) ** 4
    pdf = pd.DataFrame({"record": "r", "row": rows.ravel(), "col": cols.ravel(), "darkness": dark.ravel()})
    profiles = lines.band_profiles(spark.createDataFrame(pdf), 10)
    got = lines.line_tilt(profiles, 10).first()
    assert got["period"] == pytest.approx(8.0, abs=0.02) and got["reason"] is None
    assert got["angle"] == pytest.approx(-angle, abs=0.05)


def test_two_way_average_makes_both_orders_agree():
    x = np.random.default_rng(2).normal(size=80)
    assert np.allclose(filters.two_way_average(np.full(60, 2.5), 7), 2.5)
    y = filters.two_way_average(x, 7)
    assert np.allclose(y, filters.two_way_average(x[::-1], 7)[::-1])
    triangle = np.convolve(np.ones(7), np.ones(7)) / 49
    assert np.allclose(y[12:-12], np.convolve(x, triangle, mode="same")[12:-12])


def test_column_map_follows_uneven_lines(spark):
    from strandscope.operators import columns

    period, g0, n_lines = 8.0, 60.5, 250
    x_of = lambda m: g0 + m * period + 2.5 * np.sin(2 * np.pi * m / 180)
    cols = np.arange(2160)
    dark = np.zeros(cols.size)
    for k in range(-7, n_lines + 12):
        dark += (2.0 if k % 5 == 0 else 1.0) * 40 * np.exp(-0.5 * ((cols + 0.5 - x_of(k) - 0.5) / 1.0) ** 2)
    profiles = spark.createDataFrame(pd.DataFrame({"record": "p", "band": np.repeat([0, 1, 2], cols.size), "col": np.tile(cols, 3), "v": np.tile(dark, 3)}))
    pages = spark.createDataFrame([("p", g0, 62.5 * period)], "record string, g0 double, pitch double")
    edges = spark.createDataFrame([("p", float(x_of(m)), float(m)) for m in (0, 62.5, 125, 187.5, 250)], "record string, x double, mm double")
    verdict, knots = columns.column_map(profiles, pages, edges)
    v = verdict.first()
    assert v["reason"] is None and not v["dead_band"] and v["coverage"] > 0.95
    got = knots.toPandas().sort_values("m")
    inside = got[(got.m > 10) & (got.m < 240)]
    assert len(inside) > 400 and np.abs(inside["x"] - x_of(inside["m"])).max() < 0.4


def test_sliding_max_up_to_a_column(spark):
    rows = [(k, t, float((t * 7) % 11)) for k, n in (("a", 12), ("b", 3)) for t in range(-1, n)]
    df = spark.createDataFrame(rows, "key string, t int, v double").withColumn("total", F.lit(12))
    got = {(r.key, r.window_start): (r.window_max, r.n) for r in windows.sliding_max(df, ["key"], "t", "v", 4, 3, F.col("total")).collect()}
    want = {}
    for key in "ab":
        for start in range(0, 12 - 4 + 1, 3):
            inside = [v for k, t, v in rows if k == key and start <= t < start + 4]
            if inside:
                want[key, start] = (max(inside), len(inside))
    assert got == want
    assert got == {(r.key, r.window_start): (r.window_max, r.n) for r in windows.sliding_max(df, ["key"], "t", "v", 4, 3, 12).collect()}


def test_spline_solves_its_equations():
    rng = np.random.default_rng(1)
    for n in (4, 5, 6, 7, 40, 66, 500):
        y = rng.normal(size=n)
        rows = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
        given = np.r_[0.0, 6 * (y[2:] - 2 * y[1:-1] + y[:-2]), 0.0]
        rows[0, :3], rows[-1, -3:] = (1.0, -2.0, 1.0), (1.0, -2.0, 1.0)  # the end pieces join without a knot
        assert np.allclose(filters.spline_second_derivatives(y), np.linalg.solve(rows, given), rtol=1e-10, atol=1e-12)
    holed = np.r_[rng.normal(size=20), np.nan, rng.normal(size=200)]
    assert np.isnan(filters.spline_second_derivatives(holed)[2:-2]).all()


def test_traces_are_sharpened_side_by_side(monkeypatch):
    rng = np.random.default_rng(2)
    traces = []
    for i, n in enumerate([300, 300, 280, 300, 300, 8]):
        cols = np.delete(np.arange(200.0), slice(90, 90 + 3 * i))
        traces.append((cols, np.cumsum(rng.normal(size=cols.size)), np.linspace(-1, 205, n)))
    traces[1][1][7] = np.nan  # spoils its own trace only
    alone = [filters.sharpen(*t, 500.0) for t in traces]
    calls, one = [], filters.zero_phase
    monkeypatch.setattr(filters, "zero_phase", lambda sos, x: calls.append(x.shape) or one(sos, x))
    for a, b in zip(alone, filters.sharpen_all(traces, 500.0), strict=True):
        assert np.allclose(a, b, rtol=1e-12, atol=1e-12, equal_nan=True)
    assert sorted(calls) == [(280, 1), (300, 4)]
    assert np.isnan(alone[1]).all() and not any(np.isnan(a).any() for i, a in enumerate(alone) if i != 1)


def test_leads_of_a_page_are_sampled_together(monkeypatch):
    calls, one = [], filters.zero_phase
    monkeypatch.setattr(filters, "zero_phase", lambda sos, x: calls.append(x.shape) or one(sos, x))
    cols, y = np.arange(100.0, 700.0), 800 + 5 * np.sin(np.arange(600) / 9)
    leads = [(n, n == "II", 150.0, 100.0, 1700.0, 0.25, cols, y, None, None) for n in dims.LEADS]
    got = signals.sampled(leads)
    assert [v.size for v in got] == [5000 if n == "II" else 1250 for n in dims.LEADS] and sorted(calls) == [(1250, 11), (5000, 1)]
    assert all(np.array_equal(v, signals.sampled([lead])[0]) for v, lead in zip(got, leads, strict=True))
