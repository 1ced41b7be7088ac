"""Event streams as tie networks: the same functions take batch and streaming tables (sender, receiver, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream gets a watermark, for which its time must have a zone; a batch stays as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_ties(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Ties of tumbling or sliding windows: t_start, t_end, ego, alter, events, value. Later events than ``late`` are dropped by the watermark."""
    source = _marked(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = source.where("sender is not null and receiver is not null").groupBy(w.alias("w"), F.col("sender").alias("ego"), F.col("receiver").alias("alter")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "ego", "alter", "events", "value")


def session_ties(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Ties of sessions: runs of events of a pair with no longer gap."""
    source = _marked(events, late)
    out = source.where("sender is not null and receiver is not null").groupBy(F.session_window("ts", gap).alias("w"), F.col("sender").alias("ego"), F.col("receiver").alias("alter")).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "ego", "alter", "events")


def windowed_degree(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Events sent per node and window."""
    source = _marked(events, late)
    out = source.groupBy(F.window("ts", width).alias("w"), F.col("sender").alias("node")).agg(F.count("*").alias("sent"), F.approx_count_distinct("receiver").alias("receivers"))
    return out.select(F.col("w.start").alias("t_start"), "node", "sent", "receivers")
