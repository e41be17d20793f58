"""Streams, driven to completion, against the same semantics in batch."""

from pyspark.sql import functions as F

from skein.streaming import events as S


def test_retry_queue(spark):
    rows = [("a", "running", 0, "2024-01-01 10:00:00", True), ("b", "running", 4, "2024-01-01 10:00:00", False), ("c", "running", 1, "2024-01-01 10:00:00", False), ("d", "running", 0, "2024-01-01 01:00:00", None)]
    jobs = spark.createDataFrame(rows, "job_id string, status string, attempts int, started_at string, ok boolean").select("job_id", "status", "attempts", F.to_timestamp("started_at").alias("started_at"), "ok", F.lit(None).cast("timestamp").alias("due_at"), F.lit(None).cast("timestamp").alias("created_at"))
    out = S.next_attempt(jobs, F.col("ok"), "2024-01-01 11:00:00")
    assert {r["job_id"]: r["status"] for r in out.collect()} == {"a": "done", "b": "exhausted", "c": "failed", "d": "pending"}
    assert [r["job_id"] for r in S.pick_jobs(out, "2024-01-01 11:30:00", 5, 10).collect()] == ["c", "d"]


def test_upsert_sink_is_idempotent(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select("user_id", "event_id", "value")
    for n in range(2):  # a replay from scratch writes the same batches again
        S.upsert_sink(src, str(tmp_path / "out"), ["user_id"], "event_id", str(tmp_path / f"state{n}")).awaitTermination()
    got = S.read_upserts(spark, str(tmp_path / "out"), ["user_id"], "event_id")
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert sorted(map(tuple, got.select("user_id", "event_id").collect())) == sorted(map(tuple, want.collect()))
