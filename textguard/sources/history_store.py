"""Stored history: a Parquet table in partitions of a day, of which only what changes is written.

Retention drops the partitions that are too old and writes the one of the boundary anew;
a delete writes the partitions that hold what goes. A partition is replaced as a whole
(dynamic partition overwrite), so that a job that dies leaves the old one in place, and
all other files stay as they are. What reaches the driver are names of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.operators.state import DAY_MS

DAY = "day"


def day_of(at_ms: Column) -> Column:
    """The day (UTC) of a time in milliseconds, as text."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(at_ms / DAY_MS).cast("int")).cast("string")


def append(rows: DataFrame, path: str) -> None:
    """Adds events (with a column timestamp in milliseconds) to the table at ``path``."""
    rows.withColumn(DAY, day_of(F.col("timestamp"))).write.mode("append").partitionBy(DAY).parquet(path)


def table_folder(spark: SparkSession, path: str) -> tuple:
    """(file system, folder) of a table's path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def days(spark: SparkSession, path: str) -> list[str]:
    """The days that the table has partitions of, in order; none if there is no table."""
    fs, folder = table_folder(spark, path)
    if not fs.exists(folder):
        return []
    return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith(f"{DAY}="))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored events; ``day`` is text, so that a filter on it prunes partitions."""
    found = spark.read.parquet(path)
    return found.withColumn(DAY, F.col(DAY).cast("string"))


def _drop(spark: SparkSession, path: str, gone: list[str]) -> None:
    fs, folder = table_folder(spark, path)
    for day in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{DAY}={day}"), True)


def _rewrite(spark: SparkSession, path: str, some: list[str], keep: Column) -> None:
    """Replaces the partitions of ``some`` days by the rows that stay of them."""
    rows = read(spark, path).where(F.col(DAY).isin(some) & F.coalesce(keep, F.lit(False)))
    left = {r[0] for r in rows.select(DAY).distinct().collect()}  # days
    if left:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    _drop(spark, path, [d for d in some if d not in left])


def clean(spark: SparkSession, path: str, now_ms: int, keep_days: int | None) -> None:
    """Events older than ``keep_days`` go, those of the boundary stay; none goes if that is None."""
    if keep_days is None:
        return
    edge = now_ms - keep_days * DAY_MS
    there = days(spark, path)
    boundary = spark.range(1).select(day_of(F.lit(edge))).first()[0]
    _drop(spark, path, [d for d in there if d < boundary])
    if boundary in there and edge % DAY_MS:
        old = read(spark, path).where((F.col(DAY) == boundary) & (F.col("timestamp") < edge))
        if not old.isEmpty():
            _rewrite(spark, path, [boundary], F.col("timestamp") >= edge)


def delete(spark: SparkSession, path: str, gone: DataFrame, key: str = "id") -> None:
    """The events whose key is in ``gone`` (with a column ``key``) go; days without one keep their files."""
    if not days(spark, path):
        return
    hit = read(spark, path).join(gone.select(key).distinct(), key, "left_semi")
    some = sorted(r[0] for r in hit.select(DAY).distinct().collect())
    if not some:
        return
    rows = read(spark, path).where(F.col(DAY).isin(some)).join(gone.select(key).distinct(), key, "left_anti")
    left = {r[0] for r in rows.select(DAY).distinct().collect()}
    if left:
        columns = [c for c in read(spark, path).columns if c != DAY]
        rows.select(*columns, DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    _drop(spark, path, [d for d in some if d not in left])


def clear(spark: SparkSession, path: str) -> None:
    """All events go."""
    _drop(spark, path, days(spark, path))
