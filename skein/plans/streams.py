"""Streaming queries driven to completion over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.plans.registry import Plans
from skein.session import shared_folder, table
from skein.streaming import events as S

PLANS = Plans()


def _run(spark, stream, name):
    """The rows that a stream appends, after it has taken all there is; state goes to the session's checkpoint folder."""
    root = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("at", F.col("ts").cast("timestamp"))


@PLANS.add("""WITH w AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM (SELECT * REPLACE (ts - to_hours((event_id * 7919) % 120) AS ts) FROM events))
SELECT event_id, CASE WHEN wm IS NULL OR ts >= wm THEN 'on_time' WHEN ts >= wm - INTERVAL 48 HOUR THEN 'late_within_grace' ELSE 'late_out_of_watermark' END AS lateness FROM w""")
def stream_lateness(spark, d):
    e = _events(spark, d).withColumn("at", F.col("at") - F.make_dt_interval(hours=((F.col("event_id") * 7919) % 120).cast("int")))
    return _run(spark, S.classify_stream(e, "event_type", "at", "event_id"), "lateness").select(F.col("ident").alias("event_id"), "lateness")


@PLANS.add("""SELECT v.event_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 24 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def stream_outcome(spark, d):
    v = _events(spark, d).filter("event_type = 'view'").select("event_id", "user_id", F.col("at").alias("served_at"))
    p = _events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("at").alias("event_at"))
    return _run(spark, S.outcomes_stream(v, p, "user_id", "served_at", "event_at").select("event_id", "purchase_id"), "outcome")
