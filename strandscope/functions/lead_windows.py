"""Table function: the printed windows of every lead of a record."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from .. import dims


class LeadWindows:
    """One row per page and printed window.

    The table argument has record, lead and n (samples), partitioned by record and ordered by lead; the others are the
    samples a second and the seconds of a page. A short lead shows the stretch of its layout column, the rhythm lead the
    whole page as well (`strip`). A window that begins beyond the last sample is left out, the last one ends there.
    `number` counts the windows of the record in the order they come.
    """

    def __init__(self):
        self.number = 0

    def eval(self, row: Row, rate: int, seconds: float) -> Iterator[tuple]:
        samples, lead = row["n"], row["lead"]
        if samples is None or lead not in dims.COLUMN:
            return
        page_size, width = int(rate * seconds), int(rate * seconds / dims.N_COLUMNS)
        spans = [(dims.COLUMN[lead] * width, width, False)] + ([(0, page_size, True)] if lead == dims.RHYTHM_LEAD else [])
        for page in range(-(-samples // page_size)):
            for start, long, strip in spans:
                first = page * page_size + start
                if first < samples:
                    yield row["record"], lead, page, strip, first, min(first + long, samples), self.number
                    self.number += 1


def register_lead_windows(spark: SparkSession, name: str = "lead_windows") -> None:
    """Makes the function known to SQL: SELECT * FROM lead_windows(TABLE(t) PARTITION BY (record) ORDER BY (lead), 500, 10D)."""
    kind = "record bigint, lead string, page int, strip boolean, first bigint, last bigint, number int"
    spark.udtf.register(name, udtf(LeadWindows, returnType=kind))
