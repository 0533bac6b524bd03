"""Conditions, digests, caches, sweeps, sessions, table function, draws, robust lines, harmonics: edges and brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandscope.functions import digests
from strandscope.functions.lead_windows import register_lead_windows
from strandscope.operators import conditions, lines, resampling, robust
from strandscope.plans import sweeps
from strandscope.sources import caches
from strandscope.streaming import arrivals
from strandscope.streaming.sessions import keep_sessions, merged, sessions

NAN = float("nan")


def test_digest_equals_the_bytes_in_memory(spark):
    odd = [0.0, -0.0, 1.0, -1.5, NAN, float("inf"), -float("inf"), 1e-45, 1.17549435e-38, 1.1754942e-38, 3.4028235e38, 0.1, 2.0, 1.9999999, 16777217.0, -7.25e-12]
    rng = np.random.default_rng(0)
    rows = [(0, odd), (1, []), (2, rng.normal(size=40).tolist()), (3, (10.0 ** rng.uniform(-44, 38, 200) * rng.choice([-1, 1], 200)).tolist())]
    df = spark.createDataFrame(rows, "k int, x array<float>")
    got = {r.k: r.d for r in df.select("k", digests.array_digest(F.col("x"), digests.matrix_shape(F.size("x"), F.lit(1))).alias("d")).collect()}
    for k, x in rows:
        want = hashlib.sha1(f"({len(x)}, 1)".encode())
        want.update(np.array(x, np.float32).astype("<f4").tobytes())
        assert got[k] == want.hexdigest()
    missing = spark.createDataFrame([([None, 1.0],)], "x array<float>").select(digests.array_digest(F.col("x"), F.lit("s")).alias("d")).first().d
    assert missing == hashlib.sha1(b"s" + np.array([NAN, 1], "<f4").tobytes()).hexdigest()


def test_scores_are_kept_per_tag(spark, tmp_path):
    path, schema, asked = str(tmp_path / "cache"), "key string, sha1 string, z double", []
    inputs = lambda *rows: spark.createDataFrame(rows, "key string, sha1 string")

    def score(missing):
        asked.append(sorted(r.key for r in missing.collect()))
        return missing.withColumn("z", F.lit(float(len(asked))))

    run = lambda tag, *rows: {r.key: r.z for r in caches.scored(inputs(*rows), path, tag, score, schema).collect()}
    assert run("m1", ("a", "1"), ("b", "2")) == {"a": 1.0, "b": 1.0}
    assert run("m1", ("a", "1"), ("b", "2")) == {"a": 1.0, "b": 1.0} and len(asked) == 1
    assert run("m1", ("a", "1"), ("b", "new"), ("c", "3")) == {"a": 1.0, "b": 2.0, "c": 2.0} and asked[-1] == ["b", "c"]
    (tmp_path / "cache" / "version=9").mkdir()  # a version that was never committed does not count
    assert run("m1", ("a", "1")) == {"a": 1.0} and len(asked) == 2
    assert run("m2", ("a", "1"), ("b", "new")) == {"a": 3.0, "b": 3.0} and asked[-1] == ["a", "b"]


def test_a_sweep_goes_on_where_it_stopped(spark, tmp_path):
    folder, done = str(tmp_path / "sweep"), []
    rows = spark.createDataFrame([(i, i % 3, float(i)) for i in range(60)], "record int, t int, mv double")

    def compute(part, level, value):
        done.append(level)
        return part.groupBy("record").agg((F.sum("mv") * value).alias("y"))

    sweeps.sweep(rows, "record", (1.0, 2.0), compute, folder, chunks=3, at_most=4)
    assert len(done) == 4 and sweeps.pending(rows, "record", (1.0, 2.0), folder, 3).count() == 2
    (tmp_path / "sweep" / "level=1" / "chunk=99").mkdir(parents=True)  # a piece that a killed task left behind
    out = sweeps.sweep(rows, "record", (1.0, 2.0), compute, folder, chunks=3)
    assert len(done) == 6 and out.count() == 120
    again = sweeps.sweep(rows, "record", (1.0, 2.0), compute, folder, chunks=3)
    assert len(done) == 6 and {(r.record, r.level, r.y) for r in again.collect()} == {(i, k, float(i * (k + 1))) for i in range(60) for k in (0, 1)}
    sweeps.sweep(rows, "record", (1.0, 2.0, 3.0), compute, folder, chunks=3)
    assert len(done) == 9


def test_sessions_of_a_stream_are_those_of_the_table(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), (base + pd.Timedelta(minutes=int(m))).to_pydatetime(), float(i)) for i, m in enumerate(np.sort(rng.integers(0, 20_000, 300)))]
    schema = "event_id bigint, user_id bigint, ts timestamp, value double"
    how = {"time": "ts", "key": "user_id", "event_id": "event_id", "value": "value", "gap": "5 hours", "lateness": "2 days"}
    every = spark.createDataFrame(rows, schema)
    want = {(r.user_id, r.started, r.ended, r.n, r.total) for r in sessions(every, **how).collect()}
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def send(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        keep_sessions(arrivals.arriving_rows(spark, source, schema), target, state, ["user_id", "started"], **how)

    send(rows[:120] + rows[:50])
    early = spark.read.parquet(target).count()
    send(rows[100:300])  # the first twenty come again
    send([(-1, None, (base + pd.Timedelta(days=60)).to_pydatetime(), 0.0)])
    got = spark.read.parquet(target).where("user_id IS NOT NULL").select("user_id", "started", "ended", "n", "total")
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > early > 0
    merged(got, target, ["user_id", "started"])  # a replayed batch
    assert spark.read.parquet(target).where("user_id IS NOT NULL").count() == len(want)


def test_windows_of_leads(spark):
    register_lead_windows(spark)
    leads = spark.createDataFrame([(1, "V1", 25), (1, "II", 25), (2, "V6", 5), (2, "odd", 99), (3, "I", None)], "record bigint, lead string, n bigint")
    rows = spark.sql("SELECT * FROM lead_windows(TABLE({t}) PARTITION BY (record) ORDER BY (lead), 2, 10D)", t=leads).collect()
    got = sorted((r.record, r.number, r.lead, r.page, r.strip, r["first"], r["last"]) for r in rows)
    assert got == [(1, 0, "II", 0, False, 0, 5), (1, 1, "II", 0, True, 0, 20), (1, 2, "II", 1, False, 20, 25), (1, 3, "II", 1, True, 20, 25), (1, 4, "V1", 0, False, 10, 15)]


def test_reconciled_edges(spark):
    schema = "record string, lead string, t int, mv double, fs double"
    truth = [(r, lead, t, (float(t) if t < 2 else NAN), 500.0) for r in "abcdefg" for lead in ("I", "II") for t in range(4)]
    original = [(r, lead, t, float(t) + (0.5 if (r, lead, t) == ("b", "II", 1) else 0), 250.0 if r == "e" else 500.0) for r in "abcdefg" for lead in ("I", "II") for t in range(4)
                if r != "c" and not (r == "d" and lead == "II")]
    original = [row if row[:3] != ("f", "I", 0) else (*row[:3], NAN, 500.0) for row in original]
    reading = [(r, lead, t, float(t), 500.0) for r in "abg" for lead in ("I", "II") for t in range(4 if r != "g" else 3)]
    frames = [spark.createDataFrame(x, schema) for x in (truth, original, reading)]
    got = {r.record: r for r in conditions.reconciled(*frames).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "a": None, "b": conditions.DEVIATES, "c": conditions.NO_ORIGINAL, "d": conditions.OTHER_SIZE, "e": conditions.OTHER_RATE, "f": conditions.DEVIATES, "g": conditions.OTHER_READING}
    assert (got["b"].first_t, got["b"].first_lead, got["b"].worst, got["b"].n_off) == (1, "II", 0.5, 1) and (got["f"].first_t, got["f"].worst) == (0, 0.0)
    assert got["a"].present and not got["e"].present and got["a"].n_window == got["a"].n_read == 4
    assert conditions.reconciled(frames[0].limit(0), *frames[1:]).count() == 0
    inputs = conditions.masked_inputs(*frames, conditions.reconciled(*frames))
    assert {(r.kind, r.n) for r in inputs.groupBy("kind").agg(F.count("mv").alias("n")).collect()} == {("full", 8), ("masked", 4), ("read", 4)}


@pytest.mark.parametrize("weighting", ["rows", "group"])
def test_curves_of_draws_equal_single_fits(spark, weighting):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(x), int(rng.random() < 1 / (1 + np.exp(x - g / 9)))) for g in range(9) for x in rng.normal(size=rng.integers(3, 20))]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    got = resampling.logistic_draws(df, "x", "y", "g", n_boot=6, seed=2, weighting=weighting).collect()
    picks = {(r.draw, r.cluster): r.times for r in resampling.cluster_picks(spark, 9, 6, 2).collect()}
    sizes = np.bincount([g for g, *_ in rows])
    for r in got:
        w = np.array([picks.get((r.draw, g), 0) * (len(rows) / 9 / sizes[g] if weighting == "group" else 1) for g, *_ in rows], float)
        x, y, b = np.array([q[1] for q in rows]), np.array([q[2] for q in rows]), np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-(b[0] + b[1] * x)))
            h = w * p * (1 - p)
            b = b + np.linalg.solve([[h.sum(), (h * x).sum()], [(h * x).sum(), (h * x * x).sum()]], [(w * (y - p)).sum(), (w * (y - p) * x).sum()])
        assert r.fit == "ok" and (r.intercept, r.slope) == pytest.approx(tuple(b), abs=1e-7) and abs(r.score_0) < 1e-9
    ends = resampling.logistic_intervals(spark.createDataFrame(got)).first()
    assert ends.n_valid == 6 and ends.slope_lo <= np.median([r.slope for r in got]) <= ends.slope_hi


def test_draws_without_a_curve_are_told_apart(spark):
    base = [(1, 0.0, 0), (1, 1.0, 1), (2, 1.0, 0), (2, 0.0, 1)]
    fit = lambda rows: {r.fit for r in resampling.logistic_draws(spark.createDataFrame(rows, "g int, x double, y int"), "x", "y", "g", n_boot=12).collect()}
    assert fit([(1, float(i), 0) for i in range(3)]) == {"one_outcome"}
    assert fit([(1, 2.0, i) for i in (0, 1)]) == {"constant"}
    assert fit([(1, float(i), int(i > 1)) for i in range(4)]) == {"separated"}
    assert fit(base) == {"ok", "separated"}


def test_trimmed_line_leaves_outliers_out(spark):
    rng = np.random.default_rng(2)
    t = np.arange(60.0)
    pts = [("slope", float(x), float(3 + 0.5 * x + rng.normal(0, 0.2) + (30 if i % 10 == 0 else 0))) for i, x in enumerate(t)]
    pts += [("upright", float(7 + rng.normal(0, 0.1)), float(x)) for x in t] + [("point", 1.0, 1.0)] * 3 + [("nan", NAN, 1.0)]
    got = {r.k: r for r in robust.trimmed_line(spark.createDataFrame(pts, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert set(got) == {"slope", "upright"}
    assert -got["slope"].nx / got["slope"].ny == pytest.approx(0.5, abs=0.01) and -got["slope"].off / got["slope"].ny == pytest.approx(3, abs=0.2)
    assert got["slope"].n_kept == 54 and got["slope"].n == 60 and got["slope"].rms < 0.3
    assert abs(got["upright"].nx) == pytest.approx(1, abs=1e-3) and -got["upright"].off / got["upright"].nx == pytest.approx(7, abs=0.05)


def test_points_of_a_trimmed_line_meet_once(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, float(x), float(x + rng.normal(0, 1) + (40 if i % 9 == 0 else 0))) for k in range(5) for i, x in enumerate(range(30))], "k int, x double, y double")
    out = robust.trimmed_line(df, ["k"], "x", "y")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [r.n for r in out.collect()] == [30] * 5 and all(20 < r.n_kept < 28 for r in out.collect())


def test_consensus_and_steps(spark):
    pts = [("a", i, float(i), 2.0 * i + 1 + (50 if i in (2, 5) else 0.01 * (i % 2))) for i in range(12)] + [("b", 0, 1.0, 1.0), ("b", 1, 1.0, 2.0), ("c", 0, 0.0, 0.0)]
    got = {r.k: r for r in robust.consensus_line(spark.createDataFrame(pts, "k string, i int, x double, y double"), ["k"], "i", "x", "y", 0.1).collect()}
    assert set(got) == {"a"} and got["a"].n_agree == 10 and got["a"].slope == pytest.approx(2, abs=0.01)
    prof = [("p", i, 10.0 if i >= 17 else 0.0, float(i % 2)) for i in range(40)] + [("q", i, 0.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(prof, "k string, t int, a double, b double")
    step = {r.k: r for r in robust.step_position(df, ["k"], "t", ["a", "b"], 4).collect()}
    assert set(step) == {"p"} and step["p"].position == pytest.approx(16.5) and step["p"].step == pytest.approx(10)
    split = {r.k: r for r in robust.best_split(df, ["k"], "t", ["a", "b"], F.lit(2), F.lit(35)).collect()}
    a = np.array([[r[2], r[3]] for r in prof if r[0] == "p"])
    sse = [((a[:k] - a[:k].mean(0)) ** 2).sum() + ((a[k:] - a[k:].mean(0)) ** 2).sum() for k in range(2, 36)]
    assert split["p"].split == 2 + int(np.argmin(sse)) == 17 and split["p"].sse == pytest.approx(min(sse), abs=1e-9) and split["q"].split == 2


def test_thin_lines_are_found_below_strong_bold_ones(spark):
    col = np.arange(1000)
    rng = np.random.default_rng(0)

    def page(bold, thin, period=8.0):
        x = (col + 0.5) / period
        return bold * np.maximum(np.cos(2 * np.pi * x / 5), 0) ** 40 + thin * np.maximum(np.cos(2 * np.pi * x), 0) ** 6 + rng.uniform(0, 2, col.size)

    pages = {"bold": page(160, 25), "thin": page(0, 100, 9.3), "noise": rng.uniform(0, 100, col.size), "none": np.zeros(col.size)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"record": k, "band": 0, "col": col, "v": v}) for k, v in pages.items()]))
    got = {r.record: r for r in lines.harmonic_period(df).collect()}
    assert got["bold"].period == pytest.approx(8.0, rel=2e-3) and got["bold"].reason is None
    assert got["thin"].period == pytest.approx(9.3, rel=2e-3) and got["thin"].harmonic == 5
    assert got["noise"].reason == "no_lines" and got["none"].reason == "no_period" and got["none"].period is None
