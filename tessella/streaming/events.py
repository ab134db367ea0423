"""Micro-batches over files of events: each row once, counts by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Events as a stream; ts as an instant, which watermarks ask for."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def distinct(events: DataFrame, late: str = "30 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def tumbling(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n of windows of a length; with a ``slide`` they overlap. For streams and tables."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """user_id, start, n of each user's events with no pause longer than ``gap``. For streams and tables."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def count_batches(events: DataFrame, out: str, checkpoint: str) -> None:
    """n by event_type of each micro-batch in a folder of its own, so that a batch that runs again replaces its counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_of_windows(counts: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """Counts of windows (``keys`` and n) as of the end of the stream, windows that are still open included: each micro-batch leaves the
    windows that it changed in a folder of its own, and the last state of each counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.read.parquet(out).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def after_marker(rows: DataFrame, marker: DataFrame, time: str = "ts") -> DataFrame:
    """Rows later than the one row of ``marker`` (marker); all if it has none."""
    seen = marker.agg(F.max("marker").alias("__marker"))
    return rows.crossJoin(F.broadcast(seen)).where(F.col("__marker").isNull() | (F.col(time) > F.col("__marker"))).drop("__marker")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, in micro-batches; started again with the same checkpoint it goes on where it ended."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
