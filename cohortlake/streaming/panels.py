"""Structured Streaming views of the panel operators: yearly totals and attachment counts that grow with the input. An extension; the
batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, length: str = "1 day", late: str = "2 days", time: str = "ts", person: str = "user_id", value: str = "value") -> DataFrame:
    """person, start, n, y: sums per person and time window, kept until `late` after the window's end."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, length), person)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("y")).select(person, F.col("window.start").alias("start"), "n", "y")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", person: str = "user_id") -> DataFrame:
    """person, start, end, n: runs of events without a longer gap."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), person)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(person, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """Write finished windows as they close; the checkpoint folder must be shared."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
