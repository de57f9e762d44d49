"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM does not compile methods above 8000 bytes; larger generated stages would run interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the run-time settings above on an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fareindex")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Call-site capture for every column expression about doubles the time to build a large plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FALLBACK: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint location of the session.

    A machine-local folder is made only where the session names none and runs on one machine, as in tests; on a cluster
    every executor would write to its own disk.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="fareindex-")
        root = _FALLBACK[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, **figures: Column) -> tuple[DataFrame, dict[str, int]]:
    """The frame as a table in the work folder, so that what follows starts from files, and the number of rows with further figures.

    The figures are counted on the rows as they are written, after the last shuffle: a task that is run again counts once.
    """
    path = work_dir(df.sparkSession, label)
    seen = Observation()
    counted = df.hint("rebalance").observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()])
    counted.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), {name: seen.get.get(name) or 0 for name in ("rows", *figures)}
