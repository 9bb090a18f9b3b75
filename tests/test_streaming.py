"""Streams tell what the batch tells."""

from pyspark.sql import functions as F

from tessera.operators import jobs
from tessera.streaming import events as streams


def test_windows_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    got = streams.drained(streams.windowed(stream, "6 hours", "3 hours", "1 hour"), "windows", f"{tmp_path}/c1", "append")
    want = streams.windowed(events, "6 hours", "3 hours", "1 hour")
    rows = {(r.begins, r.event_type): (r.n, round(r.total, 6)) for r in want.collect()}
    told = {(r.begins, r.event_type): (r.n, round(r.total, 6)) for r in got.collect()}
    assert told and told.items() <= rows.items() and len(told) > 0.9 * len(rows)


def test_job_log_in_batches(spark, tmp_path):
    log = [(1, 1.0, 1, "queued"), (1, 3.0, 3, "done"), (1, 2.0, 2, "running"), (2, 5.0, 1, "running"), (2, 5.0, 2, "indexing"), (1, 9.0, 9, "running")]
    schema = "job_id long, at double, seq long, state string"
    for i, row in enumerate(log):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        assert i >= 0
    stream = streams.job_states(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log"))
    streams.drained(stream, "states", f"{tmp_path}/c2", "update")
    last = {r.job_id: r.state for r in spark.table("states").collect()}
    batch = {r.job_id: r.state for r in jobs.current(spark.createDataFrame(log, schema)).collect()}
    assert last == batch == {1: "done", 2: "indexing"}


def test_sessions_end_at_gaps(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 09:00:00"), (2, None)], "user_id long, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    got = sorted((r.user_id, r.n) for r in streams.sessions(rows, "4 hours", "1 hour").collect())
    assert got == [(1, 1), (1, 2)]
