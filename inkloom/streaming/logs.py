"""Run logs as streams: running reports per window, and the detection of stalls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, key: str, value: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """``(from_ts, key, n, mean)`` for each window; rows later than the watermark are dropped by it."""
    timed = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("from_ts"), key, "n", "mean")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """``(key, from_ts, to_ts, n)``: spells without a stall; a new one begins after every gap of so long."""
    timed = stream.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "n")


def follow(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is new in a stream of logs to the table at the path and ends; the checkpoint knows how far it came, so a
    run that was broken off, or a later one, goes on from there and no row is written twice."""
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
