"""Session construction and the few places where an operator touches the cluster's set-up."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows that an operator may hold on the driver or ship to every executor.
DRIVER_ROWS = 200_000


def session(app: str = "spanloom", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, adaptive execution)."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPANLOOM_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only in local mode, where driver and tasks share a disk."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
    return str(sc.getCheckpointDir())


def _staged(spark: SparkSession) -> str:
    return f"{_checkpoint_dir(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table that is read more than once below the shared folder and return its scan.

    Unlike a checkpoint the Parquet copy is columnar: readers prune columns and push filters. `release` removes the copies
    once their results are written. Copies of texts take `codec` zstd.
    """
    spark = df.sparkSession
    path = f"{_staged(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all tables that this session staged; frames built on them can not be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_staged(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on whichever file system its path names, and is not empty if it is a file."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(there)) and (fs.getFileStatus(there).isDirectory() or fs.getFileStatus(there).getLen() > 0)


def bounded(df: DataFrame, most: int = DRIVER_ROWS) -> list:
    """Rows of a side whose size is bounded; raises when the bound does not hold."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; this side may not be held on the driver")
    return rows
