"""Deterministic keys of cached classifier inputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import ColumnLike, col


def condition_key(condition: ColumnLike, record: ColumnLike, kind: ColumnLike, run: str | None = None) -> Column:
    """condition/record/kind; readings of a named run carry its name."""
    parts = [col(condition), col(record), col(kind)]
    return F.concat_ws("/", *parts) if run is None else F.concat_ws("/", *parts, F.lit(run))


def error_key(condition: ColumnLike, record: ColumnLike, alpha: ColumnLike) -> Column:
    """Scaled errors; 0 and 1 are the reference and the reading themselves."""
    a = col(alpha).cast("double")
    kind = F.when(a == 0, "masked").when(a == 1, "dig").otherwise(F.concat(F.lit("err_a"), a.cast("string")))
    return F.concat_ws("/", col(condition), col(record), kind)


def noise_key(record_id: ColumnLike, snr_db: ColumnLike, seed: int, level: ColumnLike) -> Column:
    """Noisy inputs; the clean level shares the key of the plain input."""
    clean = col(snr_db) == F.lit(float("inf"))
    noisy = F.concat(F.lit("noise"), col(snr_db).cast("double").cast("string"), F.lit(f"_s{seed}_l"), col(level).cast("string"))
    return F.concat_ws("/", F.lit("ptbxl500"), col(record_id).cast("string"), F.when(clean, "layout").otherwise(noisy))
