"""Page annotations (JSON), label masks (PNG) and the records kept beside them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from .records import _put

# Fields of a page annotation and of the record beside a saved mask.
PAGE_SCHEMA = (
    "height int, width int, full_mode_lead string, rotate double, crop double, "
    "leads array<struct<lead_name:string,start_sample:int,end_sample:int,plotted_pixels:array<array<double>>>>")
MASK_INFO_SCHEMA = (
    "rot_angle double, height int, width int, homography array<double>, scale double, "
    "paper_normalisation string, sheet_curl string")
MASK_SUFFIX = "_mask.png"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotated page with its record name."""
    pages = spark.read.schema(PAGE_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return pages.withColumn("record", F.regexp_replace(name, r"\.json$", ""))


def lead_points(pages: DataFrame) -> DataFrame:
    """One row per plotted point: lead entry in file order, point in drawing order."""
    entries = pages.select("record", "height", "width", "full_mode_lead", F.posexplode("leads").alias("lead_order", "l"))
    length = F.col("l.end_sample") - F.col("l.start_sample")
    label = F.array_position(F.array(*[F.lit(n) for n in dims.LEADS]), F.col("l.lead_name")).cast("int")
    entries = entries.select("record", "height", "width", "full_mode_lead", "lead_order", F.col("l.lead_name").alias("lead"),
                             length.alias("length"), label.alias("label"), F.col("l.plotted_pixels").alias("points"))
    points = entries.filter("label > 0").select(
        *[c for c in entries.columns if c != "points"], F.posexplode("points").alias("k", "p"))
    return points.withColumn("row", F.col("p")[0]).withColumn("col", F.col("p")[1]).drop("p")


def decode_png(content: bytes) -> np.ndarray:
    """First channel of an 8-bit PNG without interlacing."""
    if content[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, shape = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at:at + 8])
        body = content[at + 8:at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
            if depth != 8 or interlace:
                raise ValueError("only 8-bit PNG files without interlacing are read")
            shape = (height, width, channels)
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    height, width, channels = shape
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:].reshape(width, channels)
        if kind == 0:
            row = line
        elif kind == 1:
            row = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            row = line + above
        else:
            row = _sequential_filter(kind, line, above)
        out[y] = above = row
    return out[..., 0]


def _sequential_filter(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    row = np.zeros_like(line)
    left = np.zeros(line.shape[1], int)
    corner = np.zeros(line.shape[1], int)
    for x in range(line.shape[0]):
        up = above[x].astype(int)
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left = (line[x].astype(int) + guess) & 255
        row[x], corner = left, up
    return row


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit grey PNG."""
    height, width = image.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8)], axis=1)
    return (SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b""))


def read_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled pixels (record, row, col, label) and page sizes (record, height, width)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + MASK_SUFFIX).load(path)
    files = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), MASK_SUFFIX.replace(".", r"\.") + "$", "")
                         .alias("record"), "content")

    def pixels(batches):
        for batch in batches:
            for record, content in zip(batch["record"], batch["content"]):
                mask = decode_png(bytes(content))
                row, col = np.nonzero(mask)
                yield pd.DataFrame({"record": record, "row": row, "col": col, "label": mask[row, col].astype(np.int32)})

    size = files.select(
        "record", F.conv(F.hex(F.substring("content", 21, 4)), 16, 10).cast("int").alias("height"),
        F.conv(F.hex(F.substring("content", 17, 4)), 16, 10).cast("int").alias("width"))
    return files.mapInPandas(pixels, "record string, row int, col int, label int"), size


def read_mask_info(spark: SparkSession, path: str) -> DataFrame:
    """What was noted beside each mask; a missing key is NULL."""
    info = spark.read.schema(MASK_INFO_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*_mask.json").json(path)
    return info.withColumn("record", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"_mask\.json$", ""))


def write_masks(mask: DataFrame, sizes: DataFrame, path: str) -> DataFrame:
    """One PNG per record, put in place by renaming; returns the records written."""
    rows = sizes.join(mask.select("record", "row", "col", "label"), "record", "left")

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        head = group.iloc[0]
        image = np.zeros((int(head["height"]), int(head["width"])), np.uint8)
        there = group.dropna(subset=["label"])
        image[there["row"].astype(int), there["col"].astype(int)] = there["label"].astype(int)
        _put(path, f"{head['record']}{MASK_SUFFIX}", encode_png(image))
        return pd.DataFrame({"record": [str(head["record"])], "n_pixels": [len(there)]})

    rows = rows.withColumn("record", F.col("record").cast("string"))
    return rows.groupBy("record").applyInPandas(encode, "record string, n_pixels bigint")


def write_mask_info(info: DataFrame, path: str) -> None:
    """Provenance as JSON lines; keys that do not apply are left out."""
    info.write.mode("append").option("ignoreNullFields", True).json(path)


def same_frame(saved: DataFrame, measured: DataFrame, angle_tolerance: float = 0.005) -> DataFrame:
    """Whether a saved mask still fits its page: the angle it was made at against today's."""
    both = saved.select("record", F.col("rot_angle").alias("saved")).join(
        measured.select("record", F.col("rot_angle").alias("now")), "record")
    off = F.abs(F.coalesce("saved", F.lit(0.0)) - F.coalesce("now", F.lit(0.0)))
    return both.withColumn("fits", off <= angle_tolerance)
