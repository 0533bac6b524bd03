import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandscope import dims
from strandscope.operators import grid, lines, masks, metrics, rows, signals, strokes
from strandscope.plans import jobs
from strandscope.sources import pages, records, tables
from strandscope.streaming import arrivals


def samples(spark, name, n=300, noise=0.0, leads=("I", "aVR")):
    rng = np.random.default_rng(1)
    rows = [(name, lead, t, float(np.sin(t / (9 + i)) + noise * rng.normal())) for i, lead in enumerate(leads) for t in range(n)]
    return spark.createDataFrame(rows, "record string, lead string, t int, mv double")


def test_records_come_back_as_written(spark, tmp_path):
    x = samples(spark, "00001_hr").withColumn("mv", F.when(F.col("t") >= 10, F.col("mv")))
    assert records.write_signals(x, str(tmp_path), comments="# Age: 5").collect()[0]["n_leads"] == 2
    head = records.read_headers(spark, str(tmp_path)).first()
    assert (head["n_signals"], head["fs"], head["n_samples"], head["names"]) == (2, 500.0, 300, ["I", "aVR"])
    got = records.read_signals(spark, str(tmp_path)).toPandas()
    want = x.toPandas()
    both = got.merge(want, on=["record", "lead", "t"], suffixes=("", "_w"))
    assert len(both) == 600 and both["mv"].isna().sum() == 20
    assert np.nanmax(abs(both["mv"] - both["mv_w"])) <= 0.0005 + 1e-12


def test_a_lead_that_is_absent(spark):
    upper = samples(spark, "r", 3, leads=("I", "AVR"))
    named = records.in_lead_order(upper, dims.lead_table(spark), allow_missing=True)
    assert {r["lead"] for r in named.select("lead").distinct().collect()} == {"I", "aVR"}
    with pytest.raises(Exception, match="lacks a lead"):
        records.in_lead_order(upper, dims.lead_table(spark)).count()


def test_evaluating_two_folders(spark, tmp_path):
    gt, pred = str(tmp_path / "gt"), str(tmp_path / "pred")
    records.write_signals(samples(spark, "a").unionByName(samples(spark, "b")), gt).collect()
    records.write_signals(samples(spark, "a-0", noise=0.01), pred).collect()
    out = jobs.evaluate_folders(spark, gt, pred, max_shift=3).collect()
    assert {(r["record"], r["prediction"], r["lead"], r["missing"]) for r in out} == {("a", "a-0", "I", False), ("a", "a-0", "aVR", False)}
    assert all(r["snr_raw"] > 30 and r["shift"] == 0 for r in out)


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    image = np.random.default_rng(kind).integers(0, 13, (7, 9)).astype(np.uint8)
    import struct
    import zlib
    lines, above = [], np.zeros(9, int)
    for row in image.astype(int):
        left, corner = np.r_[0, row[:-1]], np.r_[0, above[:-1]]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left,
                        np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, near][kind]
        lines.append(bytes([kind]) + bytes(((row - guess) % 256).astype(np.uint8)))
        above = row
    body = zlib.compress(b"".join(lines))
    head = struct.pack(">IIBBBBB", 9, 7, 8, 0, 0, 0, 0)
    content = pages.SIGNATURE + b"".join(struct.pack(">I4s", len(b), k) + b + b"\0" * 4 for k, b in ((b"IHDR", head), (b"IDAT", body)))
    assert (pages.decode_png(content) == image).all()
    assert (pages.decode_png(pages.encode_png(image)) == image).all()


def test_mask_evaluation_end_to_end(spark, tmp_path):
    ann, pred = tmp_path / "ann", tmp_path / "pred"
    os.makedirs(ann)
    page = {"height": 20, "width": 30, "full_mode_lead": "II", "rotate": 0, "crop": 0, "leads": [
        {"lead_name": "I", "start_sample": 0, "end_sample": 10, "plotted_pixels": [[5, 5], [5, 9], [5, 13]]},
        {"lead_name": "II", "start_sample": 0, "end_sample": 4, "plotted_pixels": [[1, 1], [1, 2]]},
        {"lead_name": "II", "start_sample": 0, "end_sample": 40, "plotted_pixels": [[9, 1], [9, 3]]}]}
    (ann / "p-0.json").write_text(json.dumps(page))
    mask = spark.createDataFrame([("p-0", 6, c, 1) for c in range(5, 14)] + [("p-0", 9, c, 2) for c in (1, 2, 3)],
                                 "record string, row int, col int, label int")
    sizes = spark.createDataFrame([("p-0", 20, 30)], "record string, height int, width int")
    pages.write_masks(mask, sizes, str(pred)).collect()
    (pred / "p-0_mask.json").write_text(json.dumps({"rot_angle": 0.5, "height": 20, "width": 30}))
    got = {r["lead"]: r for r in jobs.evaluate_masks(spark, str(ann), str(pred), factor=5).collect()}
    assert got["I"]["dice_raw"] == 0 and got["I"]["dice_tol"] == 1.0 and got["I"]["frames_may_differ"]
    assert got["II"]["dice_raw"] == 1.0 and got["V6"]["dice_raw"] is None


def test_a_page_is_read_back_from_its_mask(spark):
    """Draw twelve sines with the printed geometry, then read the mask."""
    height, pitch, g0 = 1700, 1700 * 62.5 / 215.9, 100.25
    per_mm = pitch / 62.5
    truth, pixels = [], set()
    for i, lead in enumerate(dims.LEADS):
        strip = lead == "II"
        n = 5000 if strip else 1250
        t = np.arange(n)
        mv = 0.5 * np.sin(2 * np.pi * (1 + 0.2 * i) * t / 500)
        truth += [("p", lead, int(k), float(v)) for k, v in zip(t, mv)]
        x = g0 + ((0 if strip else dims.COLUMN[lead]) + t / 1250) * pitch
        base = (1 - dims.baseline_ratio(lead, strip)) * height
        y = base - mv * 10 * per_mm
        cols = np.floor(x).astype(int)
        for c in np.unique(cols):
            rows = y[cols == c]
            pixels |= {("p", int(r), int(c), i + 1) for r in range(int(np.floor(rows.min())), int(np.floor(rows.max())) + 1)}
    mask = spark.createDataFrame(sorted(pixels), "record string, row int, col int, label int")
    sizes = spark.createDataFrame([("p", height, 2200)], "record string, height int, width int")
    out = jobs.read_pages_from_masks(mask, sizes, placement="start")
    grid = out["grid"].first()
    assert grid["reason"] is None and grid["pitch"] == pytest.approx(pitch, rel=2e-3) and grid["g0"] == pytest.approx(g0, abs=1.0)
    ref = spark.createDataFrame(truth, "record string, lead string, t int, mv double")
    snr = metrics.signal_snr(metrics.sample_pairs(ref, out["signals"], ["record", "lead"]), ["record", "lead"]).collect()
    assert len(snr) == 12 and min(r["snr"] for r in snr) > 15


def test_scores_are_only_computed_when_inputs_change(spark):
    inputs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, sha1 string")
    cache = spark.createDataFrame([("a", "1", 10.0), ("b", "old", 11.0)], "key string, sha1 string, z double")
    asked = []

    def score(missing):
        asked.extend(sorted(r["key"] for r in missing.collect()))
        return missing.withColumn("z", F.lit(99.0))

    got, stored = jobs.cached_scores(inputs, cache, score)
    assert asked == ["b", "c"]
    assert {(r["key"], r["z"]) for r in got.collect()} == {("a", 10.0), ("b", 99.0), ("c", 99.0)} and stored.count() == 3


def test_csv_round_trip_and_unknown_split(spark, tmp_path):
    rows = spark.createDataFrame([("r", "dev"), ("s", "eval")], tables.SPLITS)
    tables.write_csv(rows, str(tmp_path / "a"))
    assert tables.read_split(spark, str(tmp_path / "a")).count() == 2
    with pytest.raises(Exception, match="already exists"):
        tables.write_csv(rows, str(tmp_path / "a"))
    tables.write_csv(spark.createDataFrame([("r", "odd")], tables.SPLITS), str(tmp_path / "b"))
    with pytest.raises(Exception, match="unknown split"):
        tables.read_split(spark, str(tmp_path / "b")).collect()


def test_replayed_and_repeated_records_are_appended_once(spark, tmp_path):
    schema = "record string, x int"
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: arrivals.append_once(arrivals.arriving_rows(spark, source, schema), "record", target, state, lambda b: b)
    spark.createDataFrame([("a", 1), ("b", 2)], schema).write.parquet(source)
    run()
    spark.createDataFrame([("b", 3), ("c", 4)], schema).write.mode("append").parquet(source)
    run()
    got = {(r["record"], r["x"]) for r in spark.read.parquet(target).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 4)}


def test_windows_close_behind_the_watermark(spark, tmp_path):
    times = pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:02", "2024-01-01 00:20", "2024-01-01 01:00"])
    spark.createDataFrame(pd.DataFrame({"ts": times, "k": ["a", "a", "a", "b"], "v": [1.0, 2.0, 4.0, 8.0]})).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving_rows(spark, str(tmp_path / "in"), "ts timestamp, k string, v double")
    arrivals.running_summary(stream, "ts", "k", "v", "10 minutes", "5 minutes", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(str(r["start"])[11:16], r["k"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("00:00", "a", 2, 3.0), ("00:20", "a", 1, 4.0)} <= got


def drawn_page(moves, height=1700, width=2200, g0=100.25, per_mm=7.875):
    """A page whose printed lines, and traces with them, lie `moves[line]` pixels to the right in each layout row."""
    pitch = per_mm * 62.5
    truth, mask = [], set()
    dark = np.zeros((height, width))
    centres = [(1 - dims.baseline_ratio(lead)) * height for lead in ("I", "II", "III")] + [(1 - dims.baseline_ratio("II", True)) * height]
    cuts = [0, *[int((a + b) / 2) for a, b in zip(centres, centres[1:])], height]
    for line in range(4):
        k = np.arange(-40, 320)
        at = np.floor(g0 + moves[line] + k * per_mm).astype(int)
        inside = (at >= 0) & (at < width)
        dark[cuts[line]:cuts[line + 1], at[inside]] = np.where(k[inside] % 5 == 0, 160.0, 100.0)
    for i, lead in enumerate(dims.LEADS):
        strip = lead == "II"
        t = np.arange(5000 if strip else 1250)
        mv = 0.5 * np.sin(2 * np.pi * (2 + 0.3 * i) * t / 500)
        truth += [("p", lead, int(k), float(v)) for k, v in zip(t, mv)]
        x = g0 + moves[3 if strip else dims.ROW[lead]] + ((0 if strip else dims.COLUMN[lead]) + t / 1250) * pitch
        y = (1 - dims.baseline_ratio(lead, strip)) * height - mv * 10 * per_mm
        cols = np.floor(x).astype(int)
        for c in np.unique(cols):
            rows = y[cols == c]
            mask |= {("p", int(r), int(c), i + 1) for r in range(int(np.floor(rows.min())), int(np.floor(rows.max())) + 1)}
    row, col = np.nonzero(dark)
    return truth, sorted(mask), pd.DataFrame({"record": "p", "row": row, "col": col, "darkness": dark[row, col]}), (height, width)


def test_rows_are_read_along_their_own_lines(spark):
    """Two rows stand two pixels off the page's mean map: reading along the row's own map is nearer to the truth."""
    moves = (1.2, -1.2, 1.2, -1.2)
    truth, mask, ink, (height, width) = drawn_page(moves)
    ref = spark.createDataFrame(truth, "record string, lead string, t int, mv double")
    labels = spark.createDataFrame(mask, "record string, row int, col int, label int")
    sparse = spark.createDataFrame(ink)
    every = spark.range(height).select(F.lit("p").alias("record"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("col"))
    pixels = every.join(sparse, ["record", "row", "col"], "left").fillna(0.0, ["darkness"])
    pages = spark.createDataFrame([("p", 100.25, 7.875 * 62.5, height, ["II"])], "record string, g0 double, pitch double, height int, long_leads array<string>")
    profiles = lines.band_profiles(pixels)
    knots = spark.createDataFrame([("p", float(m), 100.25 + 7.875 * m) for m in range(-10, 261, 2)], "record string, m double, x double")
    got = {r.line: r for r in rows.row_maps(pixels, profiles, labels, pages, knots, dims.lead_table(spark), snap_offset=0.0).collect()}
    assert [got[i].reason for i in range(4)] == [None] * 4
    for i in range(4):
        at = np.array([k.b - 100.25 - 7.875 * k.a for k in got[i].knots])
        assert np.median(at) == pytest.approx(moves[i], abs=0.3) and got[i].shift == pytest.approx(1.2, abs=0.5) and got[i].coverage > 0.9
    centres = strokes.column_centres(labels, None).join(dims.lead_table(spark).select("label", "lead"), "label").select("record", "lead", "col", "y")
    by_row = spark.createDataFrame([(r.record, r.line, [(k.a, k.b) for k in r.knots]) for r in got.values()], "record string, line int, knots array<struct<a:double,b:double>>")
    maps = rows.reading_maps(pages, dims.lead_table(spark), knots, by_row)

    def quality(m):
        read = signals.vectorise(centres, pages, None, False, maps=m)
        return {r.lead: r.snr for r in metrics.signal_snr(metrics.sample_pairs(ref, read, ["record", "lead"]), ["record", "lead"]).collect()}

    even, own = quality(rows.reading_maps(pages, dims.lead_table(spark), knots)), quality(maps)
    assert len(own) == 12 and np.median(list(own.values())) > np.median(list(even.values())) + 3


def test_rows_without_lines_keep_the_page_map(spark):
    pages = spark.createDataFrame([("p", 0.5, 178.0, 40, ["II"])], "record string, g0 double, pitch double, height int, long_leads array<string>")
    mask = spark.createDataFrame([("p", r, c, n) for r, n in ((5, 1), (15, 5), (25, 3), (35, 2)) for c in range(0, 700, 9)], "record string, row int, col int, label int")
    pixels = spark.range(40).select(F.lit("p").alias("record"), F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(719))).alias("col"), F.lit(0.0).alias("darkness"))
    knots = spark.createDataFrame([("p", 0.0, 0.5), ("p", 89.0, 712.5)], "record string, m double, x double")
    run = lambda m, height=4, least=2: sorted((r.line, r.reason) for r in rows.row_maps(
        pixels, lines.band_profiles(pixels, height), m, pages, knots, dims.lead_table(spark), lines=22.25, band_height=height, min_rows=least).collect())
    assert run(mask, least=30) == [(i, rows.LOW_BAND) for i in range(4)]
    assert run(mask.where("label != 3")) == [(i, rows.ROW_MISSING) for i in range(4)]
    assert [x for _, x in run(mask)] == [rows.BLANK_ROW] * 4
    assert rows.reading_maps(pages, dims.lead_table(spark), knots).count() == 12


def test_the_zero_line_follows_the_limb_leads(spark):
    wave = np.sin(np.arange(1250) / 40)
    values = {"I": wave, "III": -wave / 2, "aVR": -0.75 * wave, "aVL": 0.75 * wave, "aVF": 0 * wave}
    strip = np.r_[wave / 2, np.zeros(3750)]
    read = spark.createDataFrame([("p", k, t, float(v) - 0.05) for k, x in [*values.items(), ("II", strip)] for t, v in enumerate(x)], "record string, lead string, t bigint, mv double")
    pages = spark.createDataFrame([("p", 500.0, ["II"])], "record string, pitch double, long_leads array<string>")
    moved, error = jobs.on_zero_line(read, pages)
    assert error.first().shift * 25 * 2.5 / 500 / 10 == pytest.approx(0.05, abs=1e-6)
    assert moved.where("lead = 'aVF'").agg(F.max(F.abs("mv"))).first()[0] == pytest.approx(0, abs=1e-6)


def test_pages_are_read_without_rows_of_samples(spark, monkeypatch):
    """Samples and checks of a page's one row equal those of the operators on rows, with no pixel or sample stored on the way."""
    height, pitch, rng = 1700, 1700 * 62.5 / 215.9, np.random.default_rng(3)
    cells = []
    for page in (1, 2, 3):
        for i, lead in enumerate(dims.LEADS):
            if page == 2 and lead == "aVL" or page == 3 and lead == "II":
                continue
            strip = lead == "II"
            low = int(100.25 + (0 if strip else dims.COLUMN[lead]) * pitch)
            high = int(100.25 + (4 if strip else dims.COLUMN[lead] + 1) * pitch)
            base = (1 - dims.baseline_ratio(lead, strip)) * height
            cells += [(page, int(base + 3 + 9 * np.sin(c / 7 + i) + d), c, i + 1) for c in range(low, high) for d in range(int(rng.integers(1, 3)))]
    mask = spark.createDataFrame(cells, "record long, row int, col int, label int")
    sizes = spark.createDataFrame([(p, height, 2200) for p in (1, 2, 3, 4)], "record long, height int, width int")
    table = dims.lead_table(spark).select("label", "lead")
    boxes = masks.bounding_boxes(mask, table).where("x1 IS NOT NULL").join(table, "label")
    fitted = grid.rescued_grid(boxes.select("record", "lead", "x1", (F.col("x2") - F.col("x1") + 1).alias("width")), sizes.select("record", "height"))
    good = fitted.join(sizes.select("record", "height"), "record").where("reason IS NULL")
    centres = strokes.column_centres(mask, None).join(table, "label").select("record", "lead", "col", "y")
    levelled, moved = jobs.on_zero_line(signals.vectorise(centres, good), good)
    want = {"grid": fitted, "baseline": moved, "offsets": grid.grid_offsets(boxes.select("record", "lead", "x1"), good)}
    want["signals"] = grid.assemble(levelled, want["offsets"], 5000)
    want["checks"] = grid.consistency_warning(grid.consistency(want["signals"]))
    want["signals"] = grid.rescaled(want["signals"])
    want = {name: df.toPandas() for name, df in want.items()}
    monkeypatch.setattr(jobs, "pinned", None)
    monkeypatch.setattr(signals, "vectorise", None)
    monkeypatch.setattr(strokes, "column_centres", None)
    out = jobs.read_pages_from_masks(mask, sizes)
    for name, old in want.items():
        keys = [c for c in ("record", "lead", "t") if c in old.columns]
        a, b = (x.sort_values(keys).reset_index(drop=True) for x in (old, out[name].toPandas()))
        assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) > 0
        for c in a.columns:
            if a[c].dtype.kind == "f":
                assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=0, atol=1e-7, equal_nan=True), (name, c)
            elif c != "long_leads":
                assert [None if v is None or v != v else v for v in a[c]] == [None if v is None or v != v else v for v in b[c]], (name, c)
