"""Windowed counts over a stream of events (an addition: the surveyed system has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tumbling counts per event type; works on batch and streaming tables alike (start has the type of ts)."""
    kind = events.schema["ts"].dataType
    window = F.window("ts", length)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events  # watermarks take no timestamp_ntz
    counted = timed.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast(kind).alias("start"), "event_type", "n")


def drained(counts: DataFrame, folder: str) -> None:
    """Runs a streaming aggregate over all input there is and leaves its final state in ``folder``/out as Parquet."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
