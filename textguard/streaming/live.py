"""The scanner on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.operators.detect import scan
from textguard.sources.history_store import table_folder


def scan_stream(docs: DataFrame) -> DataFrame:
    """The findings of a stream (doc_id, text): stateless, so any trigger will do."""
    return scan(docs)


def debounced_stream(events: DataFrame, key: str, at: str, value: str, gap: str = "1500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """A row for each burst of a key's events, when the watermark has passed its end."""
    events = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n_events"), F.max_by(value, F.struct(at, value)).alias("last_value"))
    return out.select(key, F.col("w.start").alias("started"), "n_events", "last_value")


def idempotent_sink(path: str, key: str, day: str | None = None):
    """A function for foreachBatch that appends the rows of a batch whose key the table
    lacks: a batch that is replayed adds nothing. With a column ``day`` that a key always
    has alike, the table is partitioned by it and only the days between the batch's first
    and last are read."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        fs, folder = table_folder(spark, path)
        if fs.exists(folder):
            known = spark.read.parquet(path)
            if day:
                bounds = fresh.agg(F.min(day).alias("first"), F.max(day).alias("last")).first()
                known = known.where(F.col(day).between(bounds["first"], bounds["last"]))
            fresh = fresh.join(known.select(key), key, "left_anti")
        out = fresh.write.mode("append")
        (out.partitionBy(day) if day else out).parquet(path)

    return write
