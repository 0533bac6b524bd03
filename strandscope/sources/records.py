"""Signal records: a header text file and 16-bit sample files beside it.

Both kinds are read with the binary file source, so listing, partition pruning and
retries are Spark's; header fields are parsed as columns and only the sample bytes go
through numpy.
"""

from __future__ import annotations

import os
import posixpath
import uuid

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import headers as H

SAMPLE_SCHEMA = "record string, lead string, t bigint, mv double, fs double"


def _files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", str(recursive).lower()).load(path))


def _base(column: str = "path"):
    return F.element_at(F.split(column, "/"), -1)


def list_files(spark: SparkSession, path: str, extensions: list[str], recursive: bool = True,
               strip_extension: bool = False) -> DataFrame:
    """File names by extension; the content is never read."""
    tail = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    found = _files(spark, path, "*", recursive).select("path").filter(tail.isin(*[e.lower() for e in extensions]))
    name = F.regexp_replace("path", r"\.[^./]*$", "") if strip_extension else F.col("path")
    return found.select(name.alias("path"), _base().alias("name"))


def list_records(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Record names, one per header file."""
    return _files(spark, path, "*.hea", recursive).select(F.regexp_replace(_base(), r"\.hea$", "").alias("record"))


def read_headers(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Header text with its parsed fields; one row per record, sample files untouched."""
    raw = _files(spark, path, "*.hea", recursive).select("path", F.decode("content", "UTF-8").alias("text"))
    return raw.select(
        F.regexp_replace(_base(), r"\.hea$", "").alias("record"), F.regexp_replace("path", r"/[^/]*$", "").alias("folder"),
        "text", H.n_signals("text").alias("n_signals"), H.sampling_frequency("text").alias("fs"),
        H.n_samples("text").alias("n_samples"), H.signal_files("text").alias("files"), H.signal_formats("text").alias("formats"),
        H.adc_gains("text").alias("gains"), H.adc_baselines("text").alias("baselines"), H.signal_units("text").alias("units"),
        H.signal_names("text").alias("names"))


def read_signals(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """One row per sample: (record, lead, t, mv, fs), NaN where the sample says not printed.

    All signals of a record are expected in one interleaved file of format 16, which must hold as
    many whole frames as the header says.
    """
    heads = read_headers(spark, path, recursive).withColumn("file", F.concat("folder", F.lit("/"), F.get("files", F.lit(0))))
    ok = (F.size("files") == 1) & F.forall("formats", lambda f: f == "16")
    heads = heads.withColumn("file", F.when(ok, F.col("file")).otherwise(
        F.raise_error(F.concat(F.lit("unsupported sample format in record "), F.col("record"))).cast("string")))
    data = _files(spark, path, "*.dat", recursive).select(F.col("path").alias("file"), "content")
    both = heads.select("record", "file", "fs", "gains", "baselines", "names", "n_samples").join(data, "file")

    def decode(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                names = list(row.names)
                raw = np.frombuffer(row.content, dtype="<i2")
                if len(row.content) % (2 * len(names)) or (row.n_samples or raw.size // len(names)) * len(names) != raw.size:
                    raise ValueError(f"record {row.record} has {len(row.content)} bytes of samples, not what its header says")
                raw = raw.reshape(-1, len(names))
                gain, zero = np.asarray(row.gains, float), np.asarray(row.baselines, float)
                mv = np.where(raw == dims.NAN_CODE, np.nan, (raw - zero) / np.where(gain == 0, 200.0, gain))
                for at in range(0, raw.shape[0], 20_000):
                    part = mv[at:at + 20_000]
                    yield pd.DataFrame({
                        "record": row.record, "lead": np.tile(names, part.shape[0]),
                        "t": np.repeat(np.arange(at, at + part.shape[0]), len(names)), "mv": part.ravel(), "fs": row.fs})

    return both.select("record", "fs", "gains", "baselines", "names", "n_samples", "content").mapInPandas(decode, SAMPLE_SCHEMA)


def in_lead_order(samples: DataFrame, leads: DataFrame, allow_missing: bool = False) -> DataFrame:
    """Samples under the standard lead names, matched whatever their case.

    A record that lacks a lead is an error, or with `allow_missing` simply has no rows
    of it.
    """
    wanted = F.broadcast(leads.select(F.upper("lead").alias("_u"), F.col("lead").alias("_lead")))
    named = samples.join(wanted, F.upper("lead") == F.col("_u")).withColumn("lead", F.col("_lead")).drop("_u", "_lead")
    if allow_missing:
        return named
    found = named.groupBy("record").agg(F.countDistinct("lead").alias("_found"))
    checked = found.withColumn("_ok", F.when(F.col("_found") == len(dims.LEADS), True).otherwise(
        F.raise_error(F.concat(F.lit("record "), F.col("record"), F.lit(" lacks a lead"))).cast("boolean")))
    return named.join(checked.filter("_ok").select("record"), "record", "left_semi")


def write_signals(samples: DataFrame, path: str, fs: int = dims.RATE, gaps_as_zero: bool = False,
                  comments: str = "") -> DataFrame:
    """Write one record per `record`; returns what was written once it is evaluated.

    A record is one page long at most, so it is encoded by one task. Files are put in
    place by renaming, which makes a repeated task harmless.
    """
    os_path = path

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        record = str(group["record"].iloc[0])
        present = list(dict.fromkeys(group["lead"]))
        names = [n for n in dims.LEADS if n in present] + [n for n in present if n not in dims.LEADS]
        n = int(group["t"].max()) + 1
        grid = np.full((n, len(names)), np.nan)
        grid[group["t"].to_numpy(), group["lead"].map({v: i for i, v in enumerate(names)}).to_numpy()] = group["mv"].to_numpy(float)
        if gaps_as_zero:
            grid = np.nan_to_num(grid, nan=0.0)
        digital = np.where(np.isfinite(grid), np.clip(np.round(grid * dims.GAIN), -32767, 32767), dims.NAN_CODE).astype("<i2")
        check = digital.astype(np.int64).sum(axis=0)
        lines = [f"{record} {len(names)} {fs} {n}"]
        for i, name in enumerate(names):
            wrapped = int((check[i] + 32768) % 65536 - 32768)
            lines.append(f"{record}.dat 16 {dims.GAIN:.1f}(0)/mV 16 0 {int(digital[0, i])} {wrapped} 0 {name}")
        text = "\n".join(lines) + "\n" + (comments.rstrip("\n") + "\n" if comments else "")
        _put(os_path, f"{record}.dat", digital.tobytes())
        _put(os_path, f"{record}.hea", text.encode())
        return pd.DataFrame({"record": [record], "n_samples": [n], "n_leads": [len(names)]})

    rows = samples.select(F.col("record").cast("string").alias("record"), "lead", F.col("t").cast("bigint").alias("t"), "mv")
    return rows.groupBy("record").applyInPandas(encode, "record string, n_samples bigint, n_leads int")


def _put(folder: str, name: str, content: bytes) -> None:
    system, root = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
    system.create_dir(root, recursive=True)
    temporary = posixpath.join(root, f".{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(temporary) as out:
        out.write(content)
    system.move(temporary, posixpath.join(root, name))
