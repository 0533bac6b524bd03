import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandscope.operators import windows
from strandscope.operators.ordered import SEGMENT, by_range, grid_numbered, neighbourhood, numbered, running_totals, value_neighbourhood
from strandscope.operators.quantiles import exact_quantiles


def hot_frame(n=600, seed=0):
    """Two thirds of the rows belong to one key."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.66, 0, rng.integers(1, 6, n))
    return pd.DataFrame({"k": key, "t": rng.permutation(n), "v": np.round(rng.normal(size=n), 2), "w": rng.integers(0, 4, n)})


def test_a_hot_key_spans_segments_and_still_adds_up(spread):
    pdf = hot_frame()
    df = spread.createDataFrame(pdf)
    assert by_range(df, ["k"], ["t"]).filter("k = 0").select(SEGMENT).distinct().count() > 1
    got = running_totals(df, ["k"], ["t"], {"run": "w"}).toPandas().sort_values(["k", "t"])
    want = pdf.sort_values(["k", "t"])
    assert (got["run"].to_numpy() == want.groupby("k")["w"].cumsum().to_numpy()).all()
    assert (got["run_total"].to_numpy() == want.groupby("k")["w"].transform("sum").to_numpy()).all()


def test_global_row_numbers(spread):
    got = numbered(spread.createDataFrame(hot_frame()), [], ["t"]).toPandas()
    assert (got["rn"] == got["t"] + 1).all() and (got["rn_total"] == 600).all()


def test_quantiles_equal_numpy(spread):
    pdf = hot_frame()
    pdf.loc[::17, "v"] = np.nan
    pdf.loc[::41, "v"] = np.inf
    df = spread.createDataFrame(pdf)
    got = exact_quantiles(df, ["k"], {"v": "v", "w": "w"}, {"median": 0.5, "p99": 0.99}).toPandas().set_index("k")
    for k, group in pdf.groupby("k"):
        v = group["v"][np.isfinite(group["v"])]
        assert got.loc[k, "v_median"] == pytest.approx(np.median(v))
        assert got.loc[k, "v_p99"] == pytest.approx(np.percentile(v, 99))
        assert got.loc[k, "w_median"] == pytest.approx(np.median(group["w"]))
    weighted = exact_quantiles(df, [], {"v": "v"}, {"q": 0.3}, weight="w").first()[0]
    ok = pdf[np.isfinite(pdf["v"])]
    assert weighted == pytest.approx(np.percentile(np.repeat(ok["v"], ok["w"]), 30))


def test_neighbours_across_chunk_borders(spark):
    pdf = pd.DataFrame({"k": 1, "t": np.arange(0, 100, 3), "v": np.arange(34.0)})
    rows = grid_numbered(spark.createDataFrame(pdf), ["k"], "t", width=7)
    got = neighbourhood(rows, ["k"], "rn", 2, lambda w: {"a": F.lag("v", 2).over(w), "b": F.lead("v", 2).over(w)}, chunk=5)
    got = got.toPandas().sort_values("t")
    assert len(got) == len(pdf)
    pd.testing.assert_series_equal(got["a"].reset_index(drop=True), pdf["v"].shift(2), check_names=False)
    pd.testing.assert_series_equal(got["b"].reset_index(drop=True), pdf["v"].shift(-2), check_names=False)


def test_value_ranges_across_chunk_borders(spark):
    pdf = pd.DataFrame({"k": 1, "m": np.arange(40) * 0.5, "v": np.arange(40.0) ** 2})
    got = value_neighbourhood(spark.createDataFrame(pdf), ["k"], "m", 1.0, lambda o: {"n": f"count(v) {o}", "s": f"sum(v) {o}"},
                              chunk=2.0).toPandas().sort_values("m")
    want = [pdf["v"][(pdf["m"] - m).abs() <= 1.0].sum() for m in pdf["m"]]
    assert got["s"].tolist() == want


def test_runs_gaps_and_jumps(spark):
    x = [2, 3, 4, 8, 9, 20]
    df = spark.createDataFrame([(1, i, float(i)) for i in x], "k int, x int, v double")
    runs = {tuple(r) for r in windows.column_runs(df, ["k"], "x").select("run_start", "run_end").collect()}
    assert runs == {(2, 5), (8, 10), (20, 21)}
    assert windows.max_gap(df, ["k"], "x").first()["max_gap"] == 10
    assert windows.max_gap(df, ["k"], "x", (F.lit(5), F.lit(12))).first()["max_gap"] == 3
    assert windows.overhang(df, ["k"], "x", (F.lit(4.0), F.lit(18.0))).first()["overhang"] == 2.5
    kept = windows.jump_runs(df, ["k"], "x", "v", 3.0, 2).toPandas().sort_values("x")
    assert kept["x"].tolist() == [2, 3, 4, 8, 9] and kept["run_length"].tolist() == [3, 3, 3, 2, 2]


def test_aperture_keeps_constants_and_inner_straight_lines(spark):
    df = spark.createDataFrame([(0, i, 0.1) for i in range(5)] + [(1, i, 2.0 * i) for i in range(5)], "k int, x int, v double")
    got = windows.aperture_filter(df, ["k"], "x", "v").toPandas().sort_values(["k", "x"])
    assert (got[got.k == 0]["filtered"] == 0.1).all()
    assert got[got.k == 1]["filtered"].tolist()[1:4] == [2.0, 4.0, 6.0]


def test_running_median_holds_the_ends(spark):
    pdf = pd.DataFrame({"k": 1, "m": np.arange(30.0), "v": np.arange(30.0)})
    got = windows.running_median(spark.createDataFrame(pdf), ["k"], "m", "v", 6.0).toPandas().sort_values("m")
    assert got["smoothed"].tolist()[5:25] == pdf["v"].tolist()[5:25]
    assert got["smoothed"].iloc[0] == 0.0 and got["smoothed"].iloc[-1] == 29.0


def test_unwrap_follows_a_ramp(spark):
    true = np.arange(50) * 0.9 + 1.0
    pdf = pd.DataFrame({"k": 1, "x": np.arange(50), "p": np.mod(true, 4.0)})
    got = windows.unwrap(spark.createDataFrame(pdf), ["k"], "x", "p", 4.0, grid=8).toPandas().sort_values("x")
    assert np.allclose(got["unwrapped"], true)


def test_spikes_need_five_rows(spark):
    df = spark.createDataFrame([(0, i, 9.0 if i == 2 else 0.0) for i in range(4)] + [(1, i, 9.0 if i == 2 else 0.0) for i in range(5)],
                               "k int, x int, v double")
    got = windows.neighbour_spikes(df, ["k"], "x", "v", 1.0).filter("spike").select("k", "x").collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_hot_keys_get_their_facts_by_broadcast(spread, monkeypatch):
    from strandscope.operators import ordered

    monkeypatch.setattr(ordered, "HOT_ROWS", 100)
    monkeypatch.setattr(ordered, "HOT_KEYS", 2)
    pdf = hot_frame()
    df = spread.createDataFrame(pdf)
    facts = df.groupBy("k").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("_rows"))
    got = ordered.attach(df, facts, ["k"])
    assert got.columns == ["k", "t", "v", "w", "mean"] and "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    got = got.toPandas().sort_values("t")
    assert np.allclose(got["mean"], pdf.groupby("k")["v"].transform("mean").loc[pdf["t"].sort_values().index])
