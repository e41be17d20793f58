"""Streams: lateness per source, windowed outcomes, idempotent sinks, a retry queue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def classify_stream(events: DataFrame, source: str, time: str, ident: str, grace_hours: int = 48) -> DataFrame:
    """Lateness classes with one watermark per source, kept as state; nothing is dropped.

    A micro-batch is taken in order of ``ident`` within a source; its size is bounded by the
    reader (``maxFilesPerTrigger``, ``maxBytesPerTrigger``), and with it what a task holds. The
    state is one timestamp per source. Rows: ident, source, time, lateness.
    """
    grace = grace_hours * 3_600_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ident")
        t = rows["micros"].to_numpy()
        first = state.get[0] if state.exists else np.iinfo(np.int64).min + grace
        mark = np.maximum.accumulate(np.concatenate([[first], t]))
        state.update((int(mark[-1]),))
        before = mark[:-1]
        late = np.where(t >= before, "on_time", np.where(t >= before - grace, "late_within_grace", "late_out_of_watermark"))
        yield pd.DataFrame({"ident": rows["ident"].to_numpy(), "source": key[0], "micros": t, "lateness": late})

    rows = events.select(F.col(ident).cast("long").alias("ident"), F.col(source).cast("string").alias("source"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"))
    return rows.groupBy("source").applyInPandasWithState(step, "ident long, source string, micros long, lateness string", "mark long", "append", GroupStateTimeout.NoTimeout)


def outcomes_stream(served: DataFrame, snapshots: DataFrame, key: str, served_at: str, event_at: str, window: Column | str = "24 hours", lateness: str = "48 hours") -> DataFrame:
    """Served rows joined with the snapshots of their maturity window, both sides bounded by watermarks."""
    s = served.withWatermark(served_at, lateness).alias("s")
    e = snapshots.withWatermark(event_at, lateness).alias("e")
    on = (F.col(f"s.{key}") == F.col(f"e.{key}")) & (F.col(f"e.{event_at}") >= F.col(f"s.{served_at}")) & (F.col(f"e.{event_at}") <= F.col(f"s.{served_at}") + F.expr(f"INTERVAL {window}"))
    return s.join(e, on, "inner")


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Counts and sums per tumbling window and kind."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"))


def upsert_sink(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Last write wins per key, idempotent on replay: each batch is a folder of its own, named by the batch.

    A replayed batch overwrites its folder, and ``read_upserts`` takes the latest row of each key.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark, path: str, keys: list[str], order: str) -> DataFrame:
    from skein.operators.upsert import last_write_wins

    return last_write_wins(spark.read.parquet(path).drop("batch"), keys, [F.col(order), F.col("_batch")]).drop("_batch")


def next_attempt(jobs: DataFrame, ok: Column, now: str, base: float = 60.0, attempts: int = 5, stale_hours: int = 2) -> DataFrame:
    """One turn of the retry queue: running jobs become done, failed with a due time, or exhausted; stale ones go back to pending."""
    from skein.functions.scalars import backoff_seconds

    at = F.lit(now).cast("timestamp")
    running = F.col("status") == "running"
    stale = running & ok.isNull() & (F.col("started_at") < at - F.expr(f"INTERVAL {stale_hours} HOURS"))
    tries = F.col("attempts") + F.when(running & ok.isNotNull(), 1).otherwise(0)
    status = F.when(stale, "pending").when(running & ok, "done").when(running & ~ok & (tries >= attempts), "exhausted").when(running & ~ok, "failed").otherwise(F.col("status"))
    due = F.when(status == "failed", F.timestamp_seconds(F.unix_timestamp(at) + backoff_seconds(base, tries))).otherwise(F.col("due_at"))
    return jobs.withColumn("_s", status).withColumn("_d", due).withColumn("attempts", tries).withColumn("status", F.col("_s")).withColumn("due_at", F.col("_d")).drop("_s", "_d")


def pick_jobs(jobs: DataFrame, now: str, attempts: int, limit: int) -> DataFrame:
    """Pending or due failed jobs with attempts left, oldest first."""
    at = F.lit(now).cast("timestamp")
    open_ = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.coalesce(F.col("due_at"), at) <= at))
    return jobs.filter(open_ & (F.col("attempts") < attempts)).orderBy(F.asc_nulls_first("created_at"), "job_id").limit(limit)
