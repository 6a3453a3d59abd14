"""Incremental work: what has changed between two scans, once or as a stream of scan snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = "scan_id long, scanned_at timestamp, relative_path string, content_hash string"


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """relative_path, change (added, changed, removed) by content hash; equal files give no row."""
    old = before.select(F.col("relative_path").alias("p"), F.col("content_hash").alias("h"))
    both = old.join(after.select("relative_path", "content_hash"), F.col("p") == F.col("relative_path"), "full")
    change = F.when(F.col("p").isNull(), "added").when(F.col("relative_path").isNull(), "removed").when(F.col("h") != F.col("content_hash"), "changed")
    return both.select(F.coalesce("relative_path", "p").alias("relative_path"), change.alias("change")).where("change IS NOT NULL")


def new_contents(spark: SparkSession, folder: str, watermark: str = "1 hour") -> DataFrame:
    """A stream of (path, content) pairs not seen within the watermark, from a folder of scan snapshots (Parquet).

    State is held for each pair until the watermark passes it, so it is bounded by the snapshots' rate.
    """
    rows = spark.readStream.schema(SNAPSHOT).parquet(folder)
    return rows.withWatermark("scanned_at", watermark).dropDuplicatesWithinWatermark(["relative_path", "content_hash"])


def on_change(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that gives each batch of new contents to `handle`; restarts go on from the checkpoint."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
