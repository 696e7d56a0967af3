"""Writers: snapshot tables, JSON bundles with a manifest, resumable reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def snapshot(df: DataFrame, root: str, partitions: list[str] | None = None) -> str:
    """Write a new snapshot beside the old ones and return its path; a path that is read is never overwritten."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return path


def bundles(df: DataFrame, root: str, level: str = "level", body: str = "bundle") -> None:
    """One JSON text per row, in a folder per level."""
    df.select(level, F.col(body).alias("value")).write.mode("overwrite").partitionBy(level).text(root)


def manifest(df: DataFrame, root: str) -> None:
    """The manifest as JSON lines in the order (level, published or '', title)."""
    ordered = df.repartitionByRange("level", F.coalesce("published_at", F.lit("")), "title").sortWithinPartitions("level", F.coalesce("published_at", F.lit("")), "title")
    ordered.write.mode("overwrite").json(root)


def report(df: DataFrame, path: str, key: str) -> int:
    """Append those rows to a report whose key it does not hold yet; the number of rows appended. A second run adds none."""
    spark: SparkSession = df.sparkSession
    try:
        done = spark.read.schema(df.schema).parquet(path).select(key)
        todo = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = df
    todo = todo.persist()
    try:
        n = todo.count()
        if n:
            todo.write.mode("append").parquet(path)
        return n
    finally:
        todo.unpersist()


def replace(df: DataFrame, root: str, per_file: int = 5_000) -> str:
    """Replace a table wholesale, in files of at most `per_file` rows: a new snapshot, then the pointer to it.

    Readers follow the pointer (`current`), so they see the old table or the new one and never half of either.
    """
    spark: SparkSession = df.sparkSession
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", per_file).mode("errorifexists").parquet(path)
    spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/current")
    return path


def current(spark: SparkSession, root: str) -> DataFrame:
    """The table that `replace` wrote last."""
    return spark.read.parquet(spark.read.text(f"{root.rstrip('/')}/current").first()["value"])
