"""Whole pages in one row each: the cells of a page's traces go in, its grid, samples and checks come out.

A page has twelve traces of a few thousand columns and samples. They stay where the page lies, so a reading of many
pages shuffles no samples and stores none; `grid` has the same rules for samples that come as rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import grid, signals

PIECE = 32  # pages of a batch that leave a task at once
FITTED = ("g0", "pitch", "residual", "long_leads", "reason", "rescued")
RULES = {"einthoven": grid.EINTHOVEN, "goldberger": grid.GOLDBERGER}
MEASURES = ("rms", "rms_demedian", "ratio", "n")


def packed(cells: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per page of `facts`, with its cells (record, label, col, y) as the arrays label, col and y.

    `facts` has record, height and what else is known of a page: FITTED, `applied` (a shift along x) and `maps`
    (array of lead, knots). Cells and facts meet in one grouping.
    """
    known = [c for c in facts.columns if c != "record"]
    cell = F.struct(F.col("label").cast("int").alias("label"), F.col("col").cast("int").alias("col"), F.col("y").cast("double").alias("y"))
    rows = cells.where("label IS NOT NULL AND col IS NOT NULL").select("record", cell.alias("c"))
    rows = rows.unionByName(facts.select("record", F.struct(*known).alias("f")), allowMissingColumns=True).where("record IS NOT NULL")
    pages = rows.groupBy("record").agg(F.first("f", ignorenulls=True).alias("f"), F.collect_list("c").alias("c")).where("f IS NOT NULL")
    return pages.select("record", "f.*", *[F.col(f"c.{x}").alias(x) for x in ("label", "col", "y")])


def _centres(label: np.ndarray, col: np.ndarray, y: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Columns and mean rows of each lead; a column without a row in it is NaN."""
    here = (label >= 1) & (label <= len(dims.LEADS))
    label, col, y = label[here].astype(np.int64), col[here].astype(np.int64), y[here].astype(float)
    if not label.size:
        return {}
    order = np.lexsort((col, label))
    label, col, y = label[order], col[order], y[order]
    first = np.flatnonzero(np.r_[True, (np.diff(label) != 0) | (np.diff(col) != 0)])
    told = ~np.isnan(y)
    n = np.add.reduceat(told.astype(float), first)
    mean = np.add.reduceat(np.where(told, y, 0.0), first) / np.where(n > 0, n, np.nan)
    ends = np.flatnonzero(np.r_[True, np.diff(label[first]) != 0, True])
    return {dims.LEADS[label[first[a]] - 1]: (col[first[a:b]].astype(float), mean[a:b]) for a, b in zip(ends, ends[1:], strict=False)}


def _fit(lines: dict, height: float | None) -> tuple:
    """FITTED of one page from the boxes of its leads, as `grid.rescued_grid` has them."""
    names = list(lines)
    boxes = grid._page_boxes(names, [c[0] for c, _ in lines.values()], [c[-1] - c[0] + 1 for c, _ in lines.values()])
    strips = sorted(n for n, long in zip(names, boxes[1], strict=True) if long)
    g0, pitch, residual, reason = grid._fit_page(boxes, height, grid.GRID_TOLERANCE, True)
    if reason in (grid.EDGES_OFF, grid.EDGES_LOST):
        again = grid._fit_page(boxes, height, grid.RESCUE_TOLERANCE, True)
        if again[3] is None:
            return (*again[:3], strips, None, True)
    return g0, pitch, residual, strips, reason, False


def _side_by_side(samples: dict[str, tuple[int, np.ndarray]], leads: Sequence[str], end: int | None = None) -> list[np.ndarray]:
    """Samples of the leads (first time, values) at the times that all of them have, before `end`."""
    if not all(n in samples for n in leads):
        return [np.empty(0)] * len(leads)
    low = max(samples[n][0] for n in leads)
    high = min([samples[n][0] + samples[n][1].size for n in leads] + ([] if end is None else [end]))
    cut = [samples[n][1][low - samples[n][0]:max(high, low) - samples[n][0]] for n in leads]
    here = np.logical_and.reduce([np.isfinite(v) for v in cut])
    return [v[here] for v in cut]


def _total(values: list[np.ndarray], signs: Sequence[float]) -> np.ndarray:
    return sum((s * v for s, v in zip(signs, values, strict=True)), 0.0)


def _rule(samples: dict, leads: Sequence[str], signs: Sequence[float]) -> tuple:
    """MEASURES of a rule, as `grid.rule_residual` has them."""
    values = _side_by_side(samples, leads)
    r = _total(values, signs)
    if not r.size:
        return None, None, None, 0
    square, middle = (r * r).mean(), np.median(r)
    level = sum(np.sqrt((v * v).mean()) for v in values) / len(values)
    rest = square - 2 * middle * r.mean() + middle * middle
    return np.sqrt(square), np.sqrt(max(rest, 0.0)), np.sqrt(square) / level if level != 0 else None, r.size


def _baseline(timed: dict, pitch: float, mv_per_px: float) -> tuple[float, float | None]:
    """(shift, disagreement) in pixels, as `grid.baseline_shift` has them."""
    e = _total(_side_by_side(timed, grid.EINTHOVEN[0], int(dims.COLUMN_SECONDS * dims.RATE)), grid.EINTHOVEN[1])
    g = _total(_side_by_side(timed, grid.GOLDBERGER[0]), grid.GOLDBERGER[1])
    if not e.size or not g.size:
        return 0.0, None
    e, g = np.median(e), np.median(g)
    gap = -g / (3 * mv_per_px) + e / mv_per_px
    return -(3 * g + e) / (10 * mv_per_px) if abs(gap) <= grid.BASELINE_TOLERANCE * pitch else 0.0, gap


def _asked(lines: dict, fitted: tuple, height: float | None, dx: float, maps: dict) -> list[tuple]:
    """The leads of one page as `signals.sampled` takes them."""
    g0, pitch, _, strips, _, _ = fitted
    tall = np.nan if height is None else height
    return [(n, n in strips, pitch, g0, tall, dx, c, y, *maps.get(n, (None, None))) for n, (c, y) in lines.items()]


def _read(lines: dict, fitted: tuple, read: dict[str, np.ndarray], placement: str, limit: float = 10.0) -> dict:
    """Samples of one page on its zero line, at their place on the page, and its checks."""
    g0, pitch, _, strips, _, _ = fitted
    start = {n: 0.0 if n in strips else dims.COLUMN[n] * dims.COLUMN_SECONDS for n in lines}
    raw = {n: 0.0 if n in strips else (c[0] - g0) * dims.COLUMN_SECONDS / pitch for n, (c, _) in lines.items()}
    mv_per_px = 25 * dims.COLUMN_SECONDS / pitch / 10
    shift, gap = _baseline({n: (int(start[n] * dims.RATE), v) for n, v in read.items()}, pitch, mv_per_px)
    whole, end = {}, int(dims.PAGE_SECONDS * dims.RATE)
    for n, v in read.items():
        at = 0 if placement == "start" else round(start[n] * dims.RATE)
        kept = (v + shift * mv_per_px)[:max(end - at, 0)]
        if kept.size:
            whole[n] = at, kept
    out = {"shift": shift, "disagreement": gap, "rescaled": False, "leads": list(lines), "raw": list(raw.values()), "snapped": list(start.values())}
    for name, rule in RULES.items():
        out |= dict(zip((f"{name}_{m}" for m in MEASURES), _rule(whole, *rule), strict=True))
    bounds = [(v[np.isfinite(v)].min(), v[np.isfinite(v)].max()) for _, v in whole.values() if np.isfinite(v).any()]
    if bounds:
        low, high = min(b[0] for b in bounds), max(b[1] for b in bounds)
        if low < -limit or high > limit:
            span = high - low if high > low else np.nan
            out["rescaled"], whole = True, {n: (at, 2.0 * (v - low) / span - 1.0) for n, (at, v) in whole.items()}
    return out | {"t0": [whole[n][0] if n in whole else 0 for n in lines], "mv": [whole[n][1] if n in whole else np.empty(0) for n in lines]}


NOTHING = {"shift": None, "disagreement": None, "rescaled": False, "leads": [], "raw": [], "snapped": [], "t0": [], "mv": []} | {
    f"{name}_{m}": 0 if m == "n" else None for name in RULES for m in MEASURES}


def _nested(pages: list[list[np.ndarray]]) -> pa.ListArray:
    flat = [v for page in pages for v in page]
    inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([v.size for v in flat], dtype=np.int64)].astype(np.int32)),
                                     pa.array(np.concatenate(flat) if flat else np.empty(0)))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in pages], dtype=np.int64)].astype(np.int32)), inner)


def page_readings(pages: DataFrame, sharpened: bool = True, placement: str = "column") -> DataFrame:
    """One row per page of `packed`: FITTED, shift, disagreement, MEASURES of both rules, rescaled, and of each lead
    (arrays leads, raw, snapped, t0, mv) its offset on the page, the time of its first sample and its samples.

    The grid is fitted to the boxes of the leads where the page does not bring one. Pages without a grid have no leads.
    """
    given, has = "g0" in pages.columns, set(pages.columns)
    kind = pages.schema["record"].dataType.simpleString()
    types = {"g0": pa.float64(), "pitch": pa.float64(), "residual": pa.float64(), "long_leads": pa.list_(pa.string()), "reason": pa.string(), "rescued": pa.bool_(),
             "shift": pa.float64(), "disagreement": pa.float64(), **{f"{name}_{m}": pa.int64() if m == "n" else pa.float64() for name in RULES for m in MEASURES},
             "rescaled": pa.bool_(), "leads": pa.list_(pa.string()), "raw": pa.list_(pa.float64()), "snapped": pa.list_(pa.float64()), "t0": pa.list_(pa.int32())}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                column = {c: batch.column(c).to_pylist() for c in has & {"height", "applied", "maps", *FITTED}}
                out, found, asked = [], [], []
                for i in range(batch.num_rows):
                    label, col, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("label", "col", "y"))
                    lines, height = _centres(label, col, y), column["height"][i]
                    fitted = tuple(column[c][i] for c in FITTED) if given else _fit(lines, height)
                    out.append(dict(zip(FITTED, fitted, strict=True)) | NOTHING)
                    if out[-1]["reason"] is None and out[-1]["g0"] is not None:
                        maps = {m["lead"]: tuple(np.array([k[x] for k in m["knots"]], dtype=float) for x in "ab") for m in (column["maps"][i] if "maps" in has else None) or []}
                        dx = (column["applied"][i] if "applied" in has else None) or 0.0
                        found.append((out[-1], lines, fitted))
                        asked += _asked(lines, fitted, height, dx, maps)
                samples = iter(signals.sampled(asked, sharpened))  # the leads of all pages side by side
                for page, lines, fitted in found:
                    page |= _read(lines, fitted, {n: next(samples) for n in lines}, placement)
                yield pa.RecordBatch.from_pydict({"record": batch.column("record")} | {c: pa.array([p[c] for p in out], t) for c, t in types.items()} | {
                    "mv": _nested([p["mv"] for p in out])})

    names = {"double": "double", "string": "string", "bool": "boolean", "int64": "bigint", "list<item: string>": "array<string>",
             "list<item: double>": "array<double>", "list<item: int32>": "array<int>"}
    fields = ", ".join(f"{c} {names[str(t).replace('element', 'item')]}" for c, t in types.items())
    asked = [c for c in ("height", "applied", "maps", *FITTED) if c in has]
    return pages.select("record", *asked, "label", "col", "y").mapInArrow(kernel, f"record {kind}, {fields}, mv array<array<double>>")


def lead_rows(pages: DataFrame, *more: str) -> DataFrame:
    """(record, more, lead, t0, mv): one row per lead of `page_readings`, its samples as an array."""
    rows = pages.select("record", *more, F.inline(F.arrays_zip("leads", "raw", "snapped", "t0", "mv")))
    return rows.withColumnRenamed("leads", "lead")


def sample_rows(pages: DataFrame, *more: str) -> DataFrame:
    """(record, more, lead, t, mv): one row per sample of `page_readings`."""
    rows = lead_rows(pages, *more).select("record", *more, "lead", "t0", F.posexplode("mv").alias("t", "mv"))
    return rows.withColumn("t", (F.col("t") + F.col("t0")).cast("bigint")).drop("t0")
