"""Maps from millimetres to pixels of single layout rows, measured against the map of their page.

A sheet moves its rows against each other by fractions of a pixel. The printed lines are therefore read once
more in the band of each row; what they say is the displacement of the row's map from the page's. A page
has a few hundred windows and knots, so a map travels as one array per page or row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.numbers import count_where
from ..session import pinned
from .columns import BRANCH, MAX_GAP, MIN_COVERAGE, window_phases
from .lines import MIN_AMPLITUDE, comb
from .ordered import for_each
from .windows import running_median

# Width of the running median in millimetres, least height of a band in pixel rows, rows of a page.
MEDIAN_MM, MIN_BAND_ROWS, N_ROWS = 27.0, 30, 4
SUBS = 4096  # more sub-bands than a row can have

# Why a row keeps the page's map.
ROW_MISSING, ROWS_CROSSED, LOW_BAND, BLANK_BAND, NARROW_PAGE = "row_missing", "rows_crossed", "low_band", "blank_band", "narrow_page"
LINES_APART, BLANK_ROW, FEW_WINDOWS, LONG_GAP, FOLDED = "lines_apart", "blank_row", "few_windows", "long_gap", "folded"


def along(knots: Column, at: Column, slope: Column | float = 0.0) -> Column:
    """Piecewise linear value at `at` of sorted knots array<struct<a,b>>, continued with `slope` beyond the ends."""
    n, i = F.size(knots), F.size(F.filter(knots, lambda k: k["a"] <= at))
    first, last = F.get(knots, F.lit(0)), F.try_element_at(knots, F.lit(-1))
    low, high = F.get(knots, i - 1), F.get(knots, i)
    inner = low["b"] + (at - low["a"]) * (high["b"] - low["b"]) / (high["a"] - low["a"])
    return (F.when(i == 0, first["b"] + (at - first["a"]) * slope)
            .when(at > last["a"], last["b"] + (at - last["a"]) * slope).when(i == n, last["b"]).otherwise(inner))


def knot_array(a: str, b: str) -> Column:
    """Aggregate: the knots of a key in order."""
    return F.array_sort(F.collect_list(F.struct(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))))


def layout_rows(mask: DataFrame, pages: DataFrame, leads: DataFrame) -> DataFrame:
    """(record, bands, row_columns, reason): the pixel rows and layout columns of each layout row of a page.

    `mask` has (record, row, col, label), `leads` names label, lead, layout_row and layout_column. The centre of
    a row is the median of its leads' median mask rows; bands reach halfway to the neighbouring centres and as
    far beyond the outer ones. `bands` is an array of (line, low, high) by line, null without all rows in order.
    """
    counts = mask.groupBy("record", "label", "row").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(leads), "label")
    counts = counts.join(pages.select("record", "long_leads"), "record").withColumn("strip", F.array_contains("long_leads", F.col("lead")))
    by = Window.partitionBy("record", "label")
    so_far = F.sum("n").over(by.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    middle = counts.withColumn("past", 2 * so_far >= F.sum("n").over(by)).where("past").groupBy("record", "lead", "strip", "layout_row", "layout_column").agg(
        (F.min("row") + 0.5).alias("centre"))
    every = F.array(*[F.lit(c) for c in range(dims.N_COLUMNS)])
    rows = middle.withColumn("line", F.when(F.col("strip"), dims.RHYTHM_ROW).otherwise(F.col("layout_row"))).withColumn(
        "read", F.when(F.col("strip"), every).otherwise(F.array("layout_column")))
    rows = rows.groupBy("record", "line").agg(F.median("centre").alias("centre"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("read")))).alias("columns"))
    held = rows.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("line", "centre", "columns"))).alias("held"))
    page = pages.select("record", "height").join(held, "record", "left")
    c = [F.get("held", F.lit(i))["centre"] for i in range(N_ROWS)]
    edges = [c[0] - (c[1] - c[0]) / 2, *[(a + b) / 2 for a, b in zip(c, c[1:], strict=False)], c[-1] + (c[-1] - c[-2]) / 2]
    edges = [F.least(F.greatest(e, F.lit(0.0)), F.col("height").cast("double")) for e in edges]
    bands = F.array(*[F.struct(F.lit(i).alias("line"), F.ceil(edges[i]).cast("int").alias("low"), F.floor(edges[i + 1]).cast("int").alias("high")) for i in range(N_ROWS)])
    crossed = F.greatest(*[(a >= b).cast("int") for a, b in zip(c, c[1:], strict=False)]) == 1
    reason = F.when(F.coalesce(F.size("held"), F.lit(0)) < N_ROWS, ROW_MISSING).when(crossed, ROWS_CROSSED)
    return page.withColumn("reason", reason).select(
        "record", F.when(F.col("reason").isNull(), bands).alias("bands"), F.transform("held", lambda h: h["columns"]).alias("row_columns"), "reason")


def row_profiles(pixels: DataFrame, layout: DataFrame, band_height: int = 100, min_rows: int = MIN_BAND_ROWS) -> DataFrame:
    """Median darkness per column of the sub-bands of each row: (record, line, band, col, v)."""
    def cut(b: Column) -> Column:
        tall = b["high"] - b["low"]
        n = F.greatest(F.floor(tall / band_height).cast("int"), F.lit(1))
        return F.struct(b["line"].alias("line"), b["low"].alias("low"), n.alias("n"), F.floor(tall / n).cast("int").alias("tall"), tall.alias("whole"))

    cuts = layout.where("bands IS NOT NULL").select("record", F.transform("bands", cut).alias("cuts"))
    row = F.col("row")
    mine = F.filter("cuts", lambda b: (b["whole"] >= min_rows) & (row >= b["low"]) & (row < b["low"] + b["n"] * b["tall"]))
    rows = pixels.join(cuts, "record").withColumn("cut", F.get(mine, F.lit(0))).where("cut IS NOT NULL")
    sub = F.floor((row - F.col("cut.low")) / F.col("cut.tall")).cast("int")
    return rows.groupBy("record", F.col("cut.line").alias("line"), (F.col("cut.line") * SUBS + sub).alias("band"), "col").agg(F.median("darkness").alias("v"))


def _size() -> Column:
    return F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))


def _longest_gap(columns: Column, edges: Column, centres: Column) -> Column:
    """Longest stretch without a window over the runs of neighbouring columns that a row reads."""
    def of_run(start: Column) -> Column:
        last = F.array_max(F.filter(columns, lambda e: F.when(e >= start, F.forall(F.sequence(start, F.greatest(e, start)), lambda z: F.array_contains(columns, z))).otherwise(False)))
        low, high = F.get(edges, start), F.get(edges, last + 1)
        marks = F.concat(F.array(low), F.filter(centres, lambda x: (x > low) & (x < high)), F.array(high))
        return F.array_max(F.zip_with(F.slice(marks, 2, F.size(marks) - 1), F.slice(marks, 1, F.size(marks) - 1), lambda b, a: b - a))

    return F.array_max(F.transform(F.filter(columns, lambda c: ~F.array_contains(columns, c - 1)), of_run))


def row_maps(pixels: DataFrame, profiles: DataFrame, mask: DataFrame, pages: DataFrame, knots: DataFrame, leads: DataFrame,
             snap_offset: float = 0.5, columns: int = dims.N_COLUMNS, lines: float = dims.MM_PER_COLUMN, median_mm: float = MEDIAN_MM,
             band_height: int = 100, min_rows: int = MIN_BAND_ROWS) -> DataFrame:
    """One row per page and layout row: (record, line, reason, windows, inside, beyond, coverage, gap, shift, knots).

    `pages` has record, g0, pitch, height and long_leads, `profiles` the page's band profiles, `knots` the map
    (record, m, x) of each page. `knots` of the result are those of the row where `reason` is null, else null: the row then keeps
    the page's map. `beyond` counts windows whose lines are further off than a line can be told; `shift` is the
    largest move against the page's map in pixels at the knots and edges of the columns that the row reads.
    """
    pages = pages.withColumn("period", F.col("pitch") / lines)
    maps = knots.groupBy("record").agg(knot_array("m", "x").alias("page_knots"), knot_array("x", "m").alias("back"))
    grid = F.array(*[along(F.col("page_knots"), F.lit(c * float(lines)), F.col("period")) + snap_offset for c in range(columns + 1)])
    pages = pinned(pages.join(maps, "record").withColumn("edges", grid))
    layout = pinned(layout_rows(mask, pages, leads))
    every = layout.select("record", "reason", "bands", F.posexplode(F.coalesce("row_columns", F.array().cast("array<array<int>>"))).alias("line", "columns"))
    none = F.array(*[F.lit(i) for i in range(N_ROWS)])
    lost = layout.where(F.col("reason").isNotNull()).select("record", F.explode(none).alias("line"), "reason")
    rows = every.where(F.col("reason").isNull()).select("record", "line", "columns", (F.get("bands", F.col("line"))["high"] - F.get("bands", F.col("line"))["low"]).alias("tall"))

    periods = pages.select("record", "period")
    level = comb(profiles, periods).groupBy("record").agg(F.median(_size()).alias("level"))
    bands = pinned(row_profiles(pixels, layout, band_height, min_rows))
    kept = comb(bands, periods).join(level, "record").where(_size() >= MIN_AMPLITUDE * F.col("level")).select("record", "band")
    profile = bands.join(kept, ["record", "band"]).groupBy("record", "line", "col").agg(F.sum("v").alias("v"))
    lined = profile.select("record", "line").distinct().withColumn("lined", F.lit(True))
    whole = F.struct("record", "line").alias("record")
    phases = window_phases(profile.select(whole, "col", "v"), lined.join(pages, "record").select(whole, "period", "g0", "pitch"), columns)
    w = pinned(phases.select("record.record", "record.line", "w", "centre", "fine_a", "fine_phase"))

    w = w.join(w.groupBy("record", "line").agg(F.median("fine_a").alias("usual"), F.count(F.lit(1)).alias("n_windows")), ["record", "line"])
    w = w.join(pages.select("record", "period", "page_knots", "back", "edges"), "record").join(rows.select("record", "line", "columns"), ["record", "line"])
    period = F.col("period")
    w = w.withColumn("m", along(F.col("back"), F.col("centre") - snap_offset, 1 / period))
    w = w.withColumn("printed", along(F.col("page_knots"), F.bround("m", 0), period) + snap_offset)
    off = F.pmod(F.pmod(-F.col("fine_phase") / (2 * 3.141592653589793) * period, period) - F.col("printed"), period)
    w = w.withColumn("d", F.when(off > period / 2, off - period).otherwise(off)).withColumn(
        "strong", (F.col("fine_a") > 0) & (F.col("fine_a") >= MIN_AMPLITUDE * F.col("usual")))
    w = w.withColumn("near", F.abs("d") <= BRANCH * period).withColumn(
        "here", F.exists("columns", lambda c: (F.col("centre") >= F.get("edges", c)) & (F.col("centre") <= F.get("edges", c + 1))))
    w = pinned(w.select("record", "line", "centre", "m", "d", "strong", "near", "here", "n_windows"))
    kept = F.col("strong") & F.col("near")
    told = w.groupBy("record", "line").agg(
        F.max("n_windows").alias("n_windows"), count_where(F.col("here")).alias("inside"), count_where(kept & F.col("here")).alias("windows"),
        count_where(F.col("strong") & ~F.col("near") & F.col("here")).alias("beyond"), count_where(kept).alias("n_kept"),
        F.array_sort(F.collect_list(F.when(kept, F.col("centre")))).alias("centres"))
    moved = w.where(kept).select("record", "line", "m", "d")
    if median_mm > 0:
        moved = running_median(moved, ["record", "line"], "m", "d", median_mm, "d2").select("record", "line", "m", F.col("d2").alias("d"))
    moved = moved.groupBy("record", "line").agg(knot_array("m", "d").alias("moved"))

    out = rows.join(lined, ["record", "line"], "left").join(told, ["record", "line"], "left").join(moved, ["record", "line"], "left").join(
        pages.select("record", "pitch", "page_knots", "edges"), "record")
    out = out.withColumn("own", F.transform("page_knots", lambda k: F.struct(k["a"].alias("a"), (k["b"] + along(F.col("moved"), k["a"])).alias("b"))))
    spots = F.concat(F.transform("page_knots", lambda k: k["a"]), F.flatten(F.transform("columns", lambda c: F.array(c * F.lit(float(lines)), (c + 1) * F.lit(float(lines))))))
    spots = F.filter(spots, lambda m: F.exists("columns", lambda c: (m >= c * lines) & (m <= (c + 1) * lines)))
    ends = (F.get("page_knots", F.lit(0))["a"], F.try_element_at("page_knots", F.lit(-1))["a"])
    shift = F.array_max(F.transform(spots, lambda m: F.abs(along(F.col("moved"), F.least(F.greatest(m, ends[0]), ends[1])))))
    folded = F.exists(F.zip_with(F.slice("own", 2, F.size("own") - 1), F.slice("own", 1, F.size("own") - 1), lambda b, a: b["b"] - a["b"]), lambda x: x <= 0)
    coverage = F.col("windows") / F.greatest("inside", F.lit(1))
    gap = _longest_gap(F.col("columns"), F.col("edges"), F.col("centres")) / F.col("pitch")
    enough = F.coalesce("n_kept", F.lit(0)) >= 2
    out = out.withColumn("coverage", coverage).withColumn("gap", F.when(enough, gap)).withColumn("shift", F.when(enough, shift))
    reason = (F.when(F.col("tall") < min_rows, LOW_BAND).when(F.col("lined").isNull(), BLANK_BAND)
              .when(F.coalesce("n_windows", F.lit(0)) < 2, NARROW_PAGE).when(~enough & (F.col("beyond") > 0), LINES_APART)
              .when(~enough, BLANK_ROW).when(F.col("coverage") < MIN_COVERAGE, FEW_WINDOWS).when(F.col("gap") > MAX_GAP, LONG_GAP).when(folded, FOLDED))
    out = out.withColumn("reason", reason).select(
        "record", "line", "reason", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("windows", "inside", "beyond")], "coverage", "gap", "shift",
        F.when(F.col("reason").isNull(), F.col("own")).alias("knots"))
    return out.unionByName(lost, allowMissingColumns=True)


def reading_maps(pages: DataFrame, leads: DataFrame, page_maps: DataFrame, row_maps: DataFrame | None = None) -> DataFrame:
    """(record, lead, knots) for every lead of the pages that have a map: its row's, else its page's.

    `page_maps` has (record, m, x) of the pages whose map is to be used; other pages stay on their even columns.
    """
    maps = page_maps.groupBy("record").agg(knot_array("m", "x").alias("page_knots"))
    line = F.when(F.array_contains("long_leads", F.col("lead")), dims.RHYTHM_ROW).otherwise(F.col("layout_row"))
    wanted = for_each(maps.join(pages.select("record", "long_leads"), "record"), leads.select("lead", "layout_row")).withColumn("line", line)
    if row_maps is not None:
        wanted = wanted.join(row_maps.select("record", "line", "knots"), ["record", "line"], "left").withColumn("page_knots", F.coalesce("knots", "page_knots"))
    return wanted.select("record", "lead", F.col("page_knots").alias("knots"))

