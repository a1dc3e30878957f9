"""Structured Streaming forms of the daily counts, sliding statistics and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only Parquet log of a stream: takes what is there and ends; the next run goes on from the checkpoint."""
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_state(query: StreamingQuery) -> dict:
    """What a caller polls: running, done or failed, and the rows read so far."""
    failed = query.exception()
    status = "failed" if failed else "running" if query.isActive else "done"
    return {"id": query.id, "status": status, "rows": sum(p["numInputRows"] for p in query.recentProgress), "error": str(failed) if failed else None}


def timed(events: DataFrame) -> DataFrame:
    """Event time as a timestamp, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def sliding(events: DataFrame, late: str = "1 hour") -> DataFrame:
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day").alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")).select(F.col("w.start").cast("date").alias("day"), "n", "mean", "std")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return s.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
