"""The twelve channels ("leads") and the standard printed layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Lead names in label order (label 1..12, 0 is background).
LEADS = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")
# Column and row of each lead in the 3 x 4 layout; the rhythm strip is a full-width copy of II.
COLUMN = {"I": 0, "II": 0, "III": 0, "aVR": 1, "aVL": 1, "aVF": 1, "V1": 2, "V2": 2, "V3": 2, "V4": 3, "V5": 3, "V6": 3}
ROW = {"I": 0, "aVR": 0, "V1": 0, "V4": 0, "II": 1, "aVL": 1, "V2": 1, "V5": 1, "III": 2, "aVF": 2, "V3": 2, "V6": 2}
RHYTHM_LEAD, RHYTHM_ROW = "II", 3
N_COLUMNS = 4
COLUMN_SECONDS, PAGE_SECONDS = 2.5, 10.0
MM_PER_COLUMN = 62.5  # 25 mm per second
PAGE_HEIGHT_MM = 215.9
RATE = 500  # samples per second of a written record
GAIN, NAN_CODE = 1000.0, -32768  # fixed values of the 16-bit sample format

# Height of a lead's zero line above the lower edge, in sixths of the page.
BASELINE_SIXTHS = {0: 3.5, 1: 2.5, 2: 1.5}


def baseline_ratio(lead: str, rhythm: bool = False) -> float:
    if rhythm:
        return 1 / 12 + 0.3 / 21.59
    return BASELINE_SIXTHS[ROW[lead]] / 6


def lead_table(spark: SparkSession) -> DataFrame:
    """Twelve rows: name, label, column, row, printed window in seconds, baseline ratio."""
    rows = []
    for i, lead in enumerate(LEADS):
        start = 0.0 if lead == RHYTHM_LEAD else COLUMN[lead] * COLUMN_SECONDS
        end = PAGE_SECONDS if lead == RHYTHM_LEAD else start + COLUMN_SECONDS
        rows.append((lead, i + 1, COLUMN[lead], ROW[lead], start, end, COLUMN[lead] * COLUMN_SECONDS, baseline_ratio(lead)))
    return spark.createDataFrame(
        rows, "lead string, label int, layout_column int, layout_row int, t0 double, t1 double, offset_s double, "
              "baseline_ratio double")
