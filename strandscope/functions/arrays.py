"""Helpers on short arrays (at most a few dozen elements per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_median(values: Column) -> Column:
    """Median of an array of numbers; NULL when it is empty."""
    ordered = F.sort_array(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def homography(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a row-major 3 x 3 homography."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def rotate(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about a centre."""
    a = F.radians(degrees)
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(a) - dy * F.sin(a), cy + dx * F.sin(a) + dy * F.cos(a)


def mm_to_volts(mm: Column) -> Column:
    return mm / 10.0


def mm_to_seconds(mm: Column) -> Column:
    return mm * 0.04


def inches_to_volts(inches: Column) -> Column:
    return inches * 2.54


def inches_to_seconds(inches: Column) -> Column:
    return inches * 1.016


def resampled_shape(shape: Column, spacing: Column, new_spacing: Column) -> Column:
    """Size of an image after a change of pixel spacing, halves to even."""
    return F.transform(F.arrays_zip(shape.alias("n"), spacing.alias("a"), new_spacing.alias("b")),
                       lambda s: F.bround(s["n"] * s["a"] / s["b"], 0).cast("int"))


def polynomial_rate(step: Column, initial: float, steps: int, exponent: float = 0.9) -> Column:
    """Learning rate that falls to zero as a power of the share of steps left."""
    return F.lit(initial) * F.pow(F.greatest(1.0 - step / float(steps), F.lit(0.0)), exponent)
