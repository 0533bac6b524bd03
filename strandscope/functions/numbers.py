"""Number, missing-value and rounding rules as Spark columns.

Missing metrics are NULL in tables; NaN and the infinities are only met in raw
input, so every reduction filters with `finite` first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

TRUE_WORDS = ("true", "1", "1.0")  # fixed value: spellings that count as true


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnLike) -> Column:
    """Neither NULL, NaN nor infinite."""
    x = col(c).cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c: ColumnLike) -> Column:
    x = col(c).cast("double")
    return F.when(finite(x), x)


def to_number(c: ColumnLike) -> Column:
    """Coercing cast: text that is no number becomes NULL."""
    return col(c).try_cast("double")


def text_flag(c: ColumnLike) -> Column:
    """A boolean that may have been read back as text."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def present(missing: ColumnLike) -> Column:
    """Row is usable: a NULL flag counts as present."""
    return ~F.coalesce(col(missing).cast("boolean"), F.lit(False))


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """num / den, NULL when the denominator is zero or NULL."""
    d = col(den).cast("double")
    return F.when(d != 0, col(num).cast("double") / d)


def share(condition: Column) -> Column:
    """Share of rows for which `condition` holds (an aggregate)."""
    return F.avg(condition.cast("double"))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def logistic(z: ColumnLike) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(z)))


def decibel(power: ColumnLike, noise: ColumnLike) -> Column:
    """10 log10(power / noise); +inf without noise, NULL for a silent signal with noise."""
    p, n = col(power), col(noise)
    return (
        F.when(n == 0, F.lit(float("inf")))
        .when((p > 0) & (n > 0), F.lit(10.0) * F.log10(p / n))
    )


def inverse_logistic_at(p: float, intercept: ColumnLike, slope: ColumnLike) -> Column:
    """x at which a fitted logistic curve reaches probability p; NULL for slope 0."""
    logit = F.log(F.lit(p / (1.0 - p)))
    return F.when(finite(intercept) & finite(slope) & (col(slope) != 0),
                  (logit - col(intercept)) / col(slope))


def is_number(c: ColumnLike) -> Column:
    return to_number(c).isNotNull()


def is_integer(c: ColumnLike) -> Column:
    x = to_number(c)
    return F.coalesce(finite(x) & (x == F.floor(x)), F.lit(False))


def is_finite_number(c: ColumnLike) -> Column:
    return finite(to_number(c))


def is_nan(c: ColumnLike) -> Column:
    return F.coalesce(F.isnan(to_number(c)), F.lit(False))


def number_text(c: ColumnLike) -> Column:
    """Integral text as an integer, other finite text as a float, NaN / inf as 'Unknown'.

    Anything that is no number raises, as the only sensible reaction to a broken header.
    """
    x = to_number(c)
    return (
        F.when(is_integer(c), x.cast("bigint").cast("string"))
        .when(finite(x), x.cast("string"))
        .when(x.isNotNull(), F.lit("Unknown"))
        .otherwise(F.raise_error(F.concat(F.lit("not a number: "), F.coalesce(col(c).cast("string"), F.lit("NULL"))))
                   .cast("string"))
    )


def json_number(c: ColumnLike) -> Column:
    """NaN and infinities have no JSON form: NULL."""
    return finite_or_null(c)


def dead_band(c: ColumnLike, band: float) -> Column:
    """Small corrections are not applied at all."""
    return F.when(F.abs(col(c)) < F.lit(band), F.lit(0.0)).otherwise(col(c))
