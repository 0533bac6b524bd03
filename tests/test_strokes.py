"""Traces read off their pixels: a mask may bring its ink, rows of a page are judged where they lie."""

import numpy as np
import pytest

from strandscope.operators import strokes


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(5)
    mask = {(r, c): 1 + (c >= 40) for c in range(0, 80, 5) for r in range(5, 60) for c in ((c, c + 1) if r % 3 else (c,))}
    ink = {(r, c + d): float(rng.integers(80, 255)) for (r, c) in mask for d in (0, 1)}
    rows = [("p", r, c, label, ink.get((r, c), 0.0)) for (r, c), label in mask.items()]
    own = spark.createDataFrame(rows, "record string, row int, col int, label int, ink double")
    return mask, ink, own, spark.createDataFrame([("p", r, c, v) for (r, c), v in ink.items()], "record string, row int, col int, ink double")


def test_a_mask_brings_its_ink(spark, drawn):
    _, _, own, ink = drawn
    told = lambda df: {(r.label, r.col): (pytest.approx(r.y_mask), pytest.approx(r.y)) for r in df.collect()}
    plan = strokes.inked(own, ink)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert told(strokes.column_centres(own, ink)) == told(strokes.column_centres(own.drop("ink"), ink))


def test_shift_equals_a_walk_over_the_runs(spark, drawn):
    mask, ink, own, frame = drawn
    p95 = {k: np.quantile([ink.get(p, 0.0) for p, v in mask.items() if v == k], 0.95) for k in (1, 2)}
    rows = {k: {} for k in (1, 2)}
    for (r, c), k in mask.items():
        rows[k].setdefault(c, []).append(r)
    steep = {(r, c) for (r, c), k in mask.items() if len(rows[k][c]) >= 6 and min(rows[k][c]) + 2 <= r <= max(rows[k][c]) - 2}
    want = []
    for (r, c), k in mask.items():
        if mask.get((r, c - 1)) == k:
            continue
        e = c
        while mask.get((r, e + 1)) == k:
            e += 1
        seen = range(c - 2, e + 3)
        dark = np.array([ink.get((r, x), 0.0) for x in seen])
        if any((r, x) in steep for x in range(c, e + 1)) and c >= 2 and e + 2 < 79 and sum((r, x) in mask for x in seen) == e - c + 1 and dark.max() >= 0.5 * p95[k]:
            want.append((dark ** 2 @ np.array(seen)) / (dark ** 2).sum() - (c + e) / 2)
    width = spark.createDataFrame([("p", 79)], "record string, width int")
    for given in (own, own.drop("ink")):
        got = strokes.trace_shift(given, frame, width).first()
        assert got.n_rows == len(want) > 30 and got.median == pytest.approx(np.median(want)) and got.dx == got.median
