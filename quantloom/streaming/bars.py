"""Bars and state over streams of prints.

The same totals as the batch operators, with watermarks for late prints: in append mode a bar comes out once, when the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A folder of event files as a stream; schema from the files there.

    What has gathered is read at once, so the order of the files doesn't matter. With `files_at_once` a backlog comes in steps, and the
    watermark takes the files for ordered in time: set it only where they are.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).parquet(path)


def prints_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("symbol"), "value", (F.floor(F.col("value") * 100) % 500 + 1).cast("double").alias("volume"))


def window_bars(prints: DataFrame, width: str = "30 minutes", slide: str | None = None, late: str = "10 minutes", deduplicate: bool = False) -> DataFrame:
    """Tumbling (or, with `slide`, sliding) bars: symbol, start, n, volume, high, low. Prints that repeat an event_id within the watermark can be dropped."""
    p = prints.withWatermark("ts", late) if prints.isStreaming else prints
    if deduplicate:
        p = p.dropDuplicatesWithinWatermark(["event_id"]) if prints.isStreaming else p.dropDuplicates(["event_id"])
    return p.groupBy("symbol", F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"), F.max("value").alias("high"), F.min("value").alias("low")).select("symbol", F.col("window.start").alias("start"), "n", "volume", "high", "low")


def session_bars(prints: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of prints that lie less than `gap` apart."""
    p = prints.withWatermark("ts", late) if prints.isStreaming else prints
    return p.groupBy("symbol", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume")).select("symbol", F.col("session_window.start").alias("start"), "n", "volume")


def running_totals(prints: DataFrame) -> DataFrame:
    """symbol, n, volume so far, after each batch (update mode): sums kept for each symbol across batches."""
    return prints.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a query over what is there now into Parquet, then stops."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def run_updates_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """The same for a query in update mode: each batch's rows go to a folder of their own, with the batch's number; a batch that runs again replaces its folder."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def newest_totals(updates: DataFrame) -> DataFrame:
    """The last totals of each symbol. updates: symbol, n, volume, batch."""
    last = updates.groupBy("symbol").agg(F.max_by(F.struct("n", "volume"), "batch").alias("x"))
    return last.select("symbol", "x.n", "x.volume")
