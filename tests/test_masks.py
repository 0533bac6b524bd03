import numpy as np
import pytest
from pyspark.sql import functions as F

from strandscope.operators import masks


def px(spark, cells, label=1, record="r"):
    return spark.createDataFrame([(record, int(r), int(c), label) for r, c in cells], "record string, row int, col int, label int")


LABELS = "label int"


def test_truncation_keeps_minus_a_half_and_the_later_lead_wins(spark):
    rows = [("r", 0, 1, 5.0, 5.0), ("r", 1, 2, 5.9, 5.2), ("r", 1, 2, -0.5, 3.0), ("r", 1, 2, -1.0, 3.0), ("r", 1, 2, 19.9, 29.9), ("r", 1, 2, 20.0, 1.0)]
    df = spark.createDataFrame(rows, "record string, lead_order int, label int, row double, col double")
    got = {(r["row"], r["col"]): r["label"] for r in masks.rasterise(df, F.lit(20), F.lit(30)).collect()}
    assert got == {(5, 5): 2, (0, 3): 2, (19, 29): 2}
    n = masks.point_counts(df, F.lit(20), F.lit(30)).first()
    assert (n["n_points"], n["n_points_dropped"], n["n_points_negative"]) == (6, 2, 1)


def test_densify_counts_and_ends(spark):
    df = spark.createDataFrame([("r", 0, 0, 0.0, 0.0), ("r", 0, 1, 3.0, 6.0), ("r", 0, 2, 3.0, 0.0), ("r", 1, 0, 1.0, 1.0)],
                               "record string, lead_order int, k int, row double, col double")
    got = masks.densify(df, ["record", "lead_order"], "k", 4).orderBy("lead_order", "k", "step").collect()
    assert len(got) == 2 * 4 + 1
    assert [(r["row"], r["col"]) for r in got[:5]] == [(0, 0), (1, 2), (2, 4), (3, 6), (3, 6)]


@pytest.mark.parametrize("pred, want", [
    ([(0, 0), (0, 1)], (1.0, 1.0, 1.0, 1.0)), ([(0, 1), (0, 2)], (0.5, 1.0, 1.0, 1.0)), ([(5, 5)], (0.0, 0.0, 0.0, 0.0)), ([], (0.0, None, 0.0, 0.0))])
def test_overlap(spark, pred, want):
    out = masks.dice_per_label(px(spark, [(0, 0), (0, 1)]), px(spark, pred), spark.createDataFrame([(1,), (2,)], LABELS))
    got = {r["label"]: r for r in out.collect()}
    assert tuple(got[1][m] for m in ("dice_raw", "precision_tol", "recall_tol", "dice_tol")) == want
    assert all(got[2][m] is None for m in masks.MASK_METRICS) and got[2]["gt_pixels"] == 0


def test_confusion_counts_with_ignored_pixels(spark):
    ref, pred = px(spark, [(0, 0), (0, 1), (1, 1)]), px(spark, [(0, 1), (1, 1), (2, 2)])
    sizes = spark.createDataFrame([("r", 16)], "record string, n_pixels int")
    row = masks.confusion_per_label(ref, pred, sizes, spark.createDataFrame([(1,)], LABELS), px(spark, [(1, 1)])).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 12) and row["dice"] == 0.5


def flood(mask):
    seen, parts = set(), []
    for start in sorted(mask):
        if start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            r, c = todo.pop()
            part.append((r, c))
            for p in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in mask and p not in seen:
                    seen.add(p)
                    todo.append(p)
        parts.append(sorted(part))
    return max(parts, key=lambda p: (len(p), [-x for x in p[0]]))


def test_largest_component_equals_flood_fill(spark):
    rng = np.random.default_rng(7)
    cells = {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((25, 25)) < 0.35))}
    got = sorted((r["row"], r["col"]) for r in masks.largest_component(px(spark, cells)).collect())
    assert got == flood(cells)


def test_a_long_snake_is_one_component(spark):
    cells = {(0, c) for c in range(0, 40)} | {(r, 39) for r in range(40)} | {(39, c) for c in range(40)} | {(20, 0)}
    assert masks.largest_component(px(spark, cells)).count() == 118


def test_rounds_are_compared_by_sums(spark, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "exceptAll", None)  # whole sets of edges against each other, twice a round
    cells = {(0, c) for c in range(9)} | {(r, 2 * r % 7) for r in range(3, 12)}
    got = sorted((r["row"], r["col"]) for r in masks.largest_component(px(spark, cells)).collect())
    assert got == flood(cells)


def test_ensemble_takes_the_highest_mean(spark):
    rows = [(1, 0, 0.6), (1, 1, 0.4), (1, 0, 0.1), (1, 1, 0.9), (2, 0, 0.5), (2, 1, 0.5)]
    out = masks.ensemble(spark.createDataFrame(rows, "p int, label int, prob double"), ["p"], "label", "prob")
    assert {(r["p"], r["label"]) for r in out.collect()} == {(1, 1), (2, 0)}


def test_parts_are_joined_within_tiles_first(spark, monkeypatch):
    """Only what touches across the rims of tiles takes part in the rounds; the rest is settled where it lies."""
    rng = np.random.default_rng(11)
    cells = {(int(r) - 40, int(c) - 3) for r, c in zip(*np.nonzero(rng.random((90, 40)) < 0.38))}
    for tile in (8, 128):
        monkeypatch.setattr(masks, "TILE", tile)
        seen = []
        digest = masks._digest
        monkeypatch.setattr(masks, "_digest", lambda edges: seen.append(edges.count()) or digest(edges))
        mask = px(spark, cells).unionByName(px(spark, {(r + 7, c) for r, c in cells}, 2)).unionByName(px(spark, {(0, 5)}, 1, "q"))
        got = {}
        for r in masks.components(mask).collect():
            got.setdefault((r["record"], r["label"], tuple(r["component"])), []).append((r["row"], r["col"]))
        assert sorted(got[("q", 1, (0, 5))]) == [(0, 5)]
        best = max((v for k, v in got.items() if k[:2] == ("r", 1)), key=lambda v: (len(v), [-x for x in min(v)]))
        assert sorted(best) == flood(cells) and all(min(v) == k[2] for k, v in got.items())
        assert sum(map(len, got.values())) == 2 * len(cells) + 1
        assert seen[0] < len(cells) / 2
        out = masks.largest_component(mask).where("label = 1 AND record = 'r'").collect()
        assert sorted((r["row"], r["col"]) for r in out) == flood(cells)
        monkeypatch.undo()
