"""Record headers as text columns: one line for the record, one per signal, then comments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ColumnLike, col

LABELS, IMAGES = "# Labels:", "# Image:"  # fixed values: comment prefixes


def strip(c: ColumnLike) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def lines(text: ColumnLike) -> Column:
    return F.split(col(text), "\n", -1)


def _after(text: ColumnLike, prefix: str) -> Column:
    return F.transform(F.filter(lines(text), lambda l: l.startswith(prefix)),
                       lambda l: strip(F.substring(l, len(prefix) + 1, 2**31 - 1)))


def variable(text: ColumnLike, prefix: str) -> Column:
    """What follows a line prefix; the last such line counts, '' without one."""
    return F.coalesce(F.try_element_at(_after(text, prefix), F.lit(-1)), F.lit(""))


def has_variable(text: ColumnLike, prefix: str) -> Column:
    return F.exists(lines(text), lambda l: l.startswith(prefix))


def variables(text: ColumnLike, prefix: str, separator: str = ",") -> Column:
    """The separated values of every line with the prefix, in order."""
    return F.flatten(F.transform(_after(text, prefix), lambda v: F.transform(
        F.split(v, separator, -1), lambda p: strip(p))))


def required_variables(text: ColumnLike, prefix: str) -> Column:
    return F.when(has_variable(text, prefix), variables(text, prefix)).otherwise(
        F.raise_error(F.lit(f"no line starts with {prefix}")).cast("array<string>"))


def header_file(record: ColumnLike) -> Column:
    return F.when(col(record).endswith(".hea"), col(record)).otherwise(F.concat(col(record), F.lit(".hea")))


def _first(text: ColumnLike, k: int) -> Column:
    return strip(F.get(F.split(F.substring_index(col(text), "\n", 1), " ", -1), F.lit(k)))


def record_name(text: ColumnLike) -> Column:
    return strip(F.get(F.split(_first(text, 0), "/", -1), F.lit(0)))


def n_signals(text: ColumnLike) -> Column:
    return _first(text, 1).try_cast("int")


def sampling_frequency(text: ColumnLike) -> Column:
    return strip(F.get(F.split(_first(text, 2), "/", -1), F.lit(0))).try_cast("double")


def n_samples(text: ColumnLike) -> Column:
    return _first(text, 3).try_cast("bigint")


def signal_lines(text: ColumnLike) -> Column:
    """The tokens of each signal line."""
    return F.transform(F.slice(lines(text), F.lit(2), F.coalesce(n_signals(text), F.lit(0))),
                       lambda l: F.split(l, " ", -1))


def _token(text: ColumnLike, k: int) -> Column:
    return F.transform(signal_lines(text), lambda t: F.get(t, F.lit(k)))


def signal_files(text: ColumnLike) -> Column:
    return F.array_distinct(F.transform(_token(text, 0), lambda t: strip(t)))


def signal_formats(text: ColumnLike) -> Column:
    """Format without its samples-per-frame, skew and offset parts."""
    return F.transform(_token(text, 1), lambda t: F.regexp_extract(t, r"^([^x:+]*)", 1))


def adc_gains(text: ColumnLike) -> Column:
    return F.transform(_token(text, 2), lambda t: F.regexp_extract(t, r"^([^/(]*)", 1).try_cast("double"))


def adc_baselines(text: ColumnLike) -> Column:
    """The bracketed baseline of the gain field, else the ADC zero."""
    def one(t: Column) -> Column:
        inside = F.regexp_extract(F.get(t, F.lit(2)), r"^[^/]*\(([^)/]*)\)", 1)
        return F.when(inside != "", inside).otherwise(F.get(t, F.lit(4))).try_cast("int")

    return F.transform(signal_lines(text), one)


def signal_units(text: ColumnLike) -> Column:
    return F.transform(_token(text, 2), lambda t: F.coalesce(F.get(F.split(t, "/", -1), F.lit(1)), F.lit("mV")))


def integer_fields(text: ColumnLike, k: int) -> Column:
    """Integer token k of each signal line: 3 resolution, 4 zero, 5 first value, 6 checksum, 7 block size."""
    return F.transform(_token(text, k), lambda t: t.try_cast("int"))


def signal_names(text: ColumnLike) -> Column:
    return _token(text, 8)


def standard_lead(name: ColumnLike) -> Column:
    """Upper case, except for the three augmented leads."""
    upper = F.upper(col(name))
    return (F.when(upper == "AVR", "aVR").when(upper == "AVL", "aVL").when(upper == "AVF", "aVF").otherwise(upper))


def lead_names(text: ColumnLike) -> Column:
    """The last token of each signal line, in standard spelling (the page generator's rule)."""
    return F.transform(signal_lines(text), lambda t: standard_lead(strip(F.element_at(t, -1))))


def rewritten(text: ColumnLike, time: ColumnLike, date: ColumnLike, notes: Column, dropped: list[str]) -> Column:
    """Header with the record time and date, without the old comment lines, with new ones."""
    all_lines = lines(text)
    first = F.array_join(F.slice(F.split(strip(F.get(all_lines, F.lit(0))), " ", -1), 1, 4), " ")
    rest = F.slice(all_lines, 2, F.size(all_lines))
    signals = F.transform(F.filter(rest, lambda l: (strip(l) != "") & ~l.startswith("#")), lambda l: strip(l))
    old = F.array(*[F.lit(p) for p in dropped])
    keep = F.filter(rest, lambda l: l.startswith("#") & ~F.exists(old, lambda p: F.startswith(l, p)))
    comments = F.transform(keep, lambda l: strip(l))
    return F.concat_ws("\n", F.concat_ws(" ", first, col(time), col(date)), F.concat(signals, comments, notes))


def with_images(text: ColumnLike, images: ColumnLike) -> Column:
    """Header with one image line that lists `images`; empty lines and old image lines go."""
    kept = F.filter(lines(text), lambda l: (l != "") & ~l.startswith(IMAGES))
    return F.concat(F.array_join(kept, "\n"), F.lit(f"\n{IMAGES} "), F.array_join(col(images), ", "), F.lit("\n"))


def image_order(names: ColumnLike) -> Column:
    """Image names by the number behind their last '-', or by name unless all have one."""
    suffix = lambda n: F.element_at(F.split(F.regexp_replace(n, r"\.[^.]*$", ""), "-", -1), -1).try_cast("double")
    numeric = F.forall(col(names), lambda n: suffix(n).isNotNull())
    by_number = F.transform(F.array_sort(F.transform(col(names), lambda n: F.struct(suffix(n).alias("k"), n.alias("n")))),
                            lambda s: s["n"])
    return F.when(numeric, by_number).otherwise(F.array_sort(col(names)))


def day_first(date: ColumnLike) -> Column:
    return F.date_format(col(date), "dd/MM/yyyy")


def id_of(record: ColumnLike) -> Column:
    """Number that a record name begins with; NULL for foreign names."""
    return F.regexp_extract(col(record), r"^([0-9]+)", 1).try_cast("bigint")
