"""Streams: windowed and session counts of events, and the state of jobs from their log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.jobs import TERMINAL


def windowed(events: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums by sliding window and type; events may be late by so much."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begins"), F.col("window.end").alias("ends"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of each user: events with less than gap between them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n")


def job_states(log: DataFrame) -> DataFrame:
    """The state of each job after each batch of its log (job_id, at, seq, state). A job that has ended stays
    ended, whatever comes late."""

    latest = F.max(F.struct(F.col("state").isin(*TERMINAL).alias("ended"), "at", "seq", "state")).alias("x")
    return log.groupBy("job_id").agg(latest).select("job_id", "x.state", "x.at")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream over files yields until all of them are read, as a table in memory; for tests and small
    jobs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
