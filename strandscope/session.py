"""Session helpers: a local builder for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandscope")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; without one only a local session may take a temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandscope-ckpt-"))


def pinned(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder so later reads see the very same rows.

    Needed wherever a plan is read more than once and holds a value that a
    recomputed task could change (a partition number, for example).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
