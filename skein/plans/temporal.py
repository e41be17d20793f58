"""As-of joins, horizons, splits, lateness and train-only statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions.scalars import argmax3, regime_logits, safe_div, softmax3, zscore
from skein.operators.asof import asof_join, classify_outcome, resolve_boundaries, temporal_pool
from skein.operators.windows import chronological_split, classify_lateness, leave_one_out_mean, supersedes_links
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()


def _asof(direction, order):
    pick, op = ("DESC", "<=") if direction == "backward" else ("", ">=")
    return f"""SELECT o_orderkey, l_shipdate, l_quantity FROM orders LEFT JOIN (
SELECT * FROM (SELECT o_orderkey AS k, l_shipdate, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate {pick}, l_extendedprice {pick}) rn
FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate {op} o_orderdate) WHERE rn = 1) ON o_orderkey = k"""


def _asof_plan(spark, d, direction):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderkey", "o_orderdate")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice")
    return asof_join(o, li, [("o_orderkey", "l_orderkey")], F.col("o_orderdate"), "l_shipdate", "l_extendedprice", ["l_shipdate", "l_quantity"], direction).select("o_orderkey", "l_shipdate", "l_quantity")


@PLANS.add(_asof("backward", "DESC"))
def asof_backward(spark, d):
    return _asof_plan(spark, d, "backward")


@PLANS.add(_asof("forward", "ASC"))
def asof_forward(spark, d):
    return _asof_plan(spark, d, "forward")


def _signups(spark, d):
    return table(spark, d, "events").filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))


_SIGN = "SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id"
_BOUND = f"""SELECT s.user_id, h.hour, (SELECT e.value FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'purchase' AND e.event_id % 5 <> 0 AND e.ts >= s.t0 + to_hours(h.hour) ORDER BY e.ts, e.value LIMIT 1) AS value,
(SELECT count(*) FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'purchase') AS n_any, (SELECT count(*) FROM events e WHERE e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts >= s.t0 + to_hours(h.hour)) AS n_after
FROM ({_SIGN}) s, (VALUES (0), (6), (24), (96)) h(hour)"""


@PLANS.add(f"SELECT user_id, hour, value, CASE WHEN value IS NOT NULL THEN NULL WHEN n_any = 0 THEN 'no_snapshots' WHEN n_after = 0 THEN 'missing_future_snapshot' ELSE 'late_data' END AS reason FROM ({_BOUND})")
def asof_boundaries(spark, d):
    snaps = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", "ts", "value", (F.col("event_id") % 5 == 0).alias("late"))
    return resolve_boundaries(_signups(spark, d), snaps, "user_id", "t0", "ts", "value", [0, 6, 24, 96], "late")


@PLANS.add("""WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), s AS (SELECT * FROM events WHERE event_type = 'purchase')
SELECT v.event_id, x.ts AS snapshot_ts, x.value, CASE WHEN v.ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-28' THEN 'not_matured_24h' WHEN x.ts IS NULL THEN 'missing_snapshot' WHEN x.ts + to_hours((x.sid * 7919) % 120) > TIMESTAMP '2024-01-28' THEN 'ingested_after_cutoff' END AS censorship
FROM v LEFT JOIN (SELECT * FROM (SELECT v.event_id AS id, s.event_id AS sid, s.ts, s.value, row_number() OVER (PARTITION BY v.event_id ORDER BY s.ts DESC, s.event_id DESC) rn
FROM v JOIN s ON v.user_id = s.user_id AND s.ts >= v.ts AND s.ts <= v.ts + INTERVAL 24 HOUR) WHERE rn = 1) x ON x.id = v.event_id""")
def outcome_attribution(spark, d):
    """Outcome of each served view: the latest snapshot within 24 hours, and why it does not count."""
    e = table(spark, d, "events")
    v = e.filter("event_type = 'view'").select(F.col("event_id").alias("row_id"), "event_id", F.col("user_id").alias("u"), F.col("ts").alias("served"))
    s = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("snapshot_ts"), "value", F.col("event_id").alias("sid"), (F.col("ts") + F.make_dt_interval(hours=((F.col("event_id") * 7919) % 120).cast("int"))).alias("ingested"))
    run = F.lit("2024-01-28").cast("timestamp_ntz")
    out = asof_join(v, s, [("u", "user_id")], F.col("served") + F.expr("INTERVAL 24 HOURS"), "snapshot_ts", "sid", ["snapshot_ts", "value", "ingested"], tolerance="24 HOURS")
    return out.select("event_id", "snapshot_ts", "value", classify_outcome(F.col("served"), 24, run, F.col("ingested")).alias("censorship"))


_SPLIT = """SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders"""
_SPLITS = f"SELECT *, CASE WHEN r <= greatest(1, floor(n * 0.70)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.70)) + greatest(1, floor(n * 0.15)) THEN 'validation' ELSE 'test' END AS split FROM ({_SPLIT})"


def _split(spark, d):
    return chronological_split(table(spark, d, "orders"), "o_orderdate", "o_orderkey")


@PLANS.add(f"SELECT o_orderkey, split FROM ({_SPLITS})")
def chronological_split_rows(spark, d):
    return _split(spark, d).select("o_orderkey", "split")


@PLANS.add(f"""SELECT split, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(DISTINCT o_orderkey) AS n_ids,
(SELECT count(*) FROM (SELECT o_custkey FROM ({_SPLITS}) GROUP BY o_custkey HAVING count(DISTINCT split) > 1)) AS shared_authors FROM ({_SPLITS}) GROUP BY split""")
def split_leakage_check(spark, d):
    s = _split(spark, d)
    shared = s.groupBy("o_custkey").agg(F.count_distinct("split").alias("k")).filter("k > 1").agg(F.count("*").alias("shared_authors"))
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.count_distinct("o_orderkey").alias("n_ids")).crossJoin(shared)


@PLANS.add(f"""SELECT s.o_orderkey, round(CASE WHEN sd = 0 THEN 0 ELSE (ln(1 + o_totalprice) - m) / sd END, 6) AS z FROM ({_SPLITS}) s,
(SELECT avg(ln(1 + o_totalprice)) AS m, coalesce(stddev_samp(ln(1 + o_totalprice)), 0) AS sd FROM ({_SPLITS}) WHERE split = 'train')""")
def train_zscores(spark, d):
    """Targets standardised by statistics of the train rows only."""
    s = _split(spark, d).withColumn("y", F.log1p("o_totalprice"))
    stats = s.filter("split = 'train'").agg(F.avg("y").alias("m"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sd"))
    return s.crossJoin(F.broadcast(stats)).select("o_orderkey", F.round(zscore("y", "m", "sd"), 6).alias("z"))


@PLANS.add(f"""WITH s AS ({_SPLITS}), a AS (SELECT o_custkey, sum(o_totalprice) t, count(*) c FROM s WHERE split = 'train' GROUP BY o_custkey), g AS (SELECT avg(o_totalprice) m FROM s WHERE split = 'train')
SELECT o_orderkey, round(CASE WHEN coalesce(c, 0) >= 2 THEN (coalesce(t, 0) - CASE WHEN split = 'train' THEN o_totalprice ELSE 0 END) / (c - (split = 'train')::INT) ELSE m END, 5) AS baseline
FROM s LEFT JOIN a ON s.o_custkey = a.o_custkey, g""")
def author_loo_baseline(spark, d):
    return leave_one_out_mean(_split(spark, d), "o_custkey", "o_totalprice", "split").select("o_orderkey", F.round("baseline", 5).alias("baseline"))


_TRAJ = f"""WITH b AS (SELECT s.user_id, h.hour, (SELECT sum(e.value) FROM events e WHERE e.user_id = s.user_id AND e.ts >= s.t0 AND e.ts <= s.t0 + to_hours(h.hour)) AS v FROM ({_SIGN}) s, (VALUES (6), (24), (96)) h(hour)),
p AS (SELECT user_id, coalesce(max(v) FILTER (WHERE hour = 6), 0) v6, coalesce(max(v) FILTER (WHERE hour = 24), 0) v24, coalesce(max(v) FILTER (WHERE hour = 96), 0) v96 FROM b GROUP BY user_id),
f AS (SELECT user_id, ln(1 + v6) / 6 AS early, (ln(1 + v24) - ln(1 + v6)) / 18 AS mid, (ln(1 + v96) - ln(1 + v24)) / 72 AS late FROM p)"""


def _trajectory(spark, d):
    e = table(spark, d, "events").join(_signups(spark, d), "user_id").filter("ts >= t0")
    upto = lambda h: F.coalesce(F.sum(F.when(F.col("ts") <= F.col("t0") + F.expr(f"INTERVAL {h} HOURS"), F.col("value"))), F.lit(0.0))
    p = e.groupBy("user_id").agg(*[upto(h).alias(f"v{h}") for h in (6, 24, 96)])
    return p.select("user_id", "v24", (F.log1p("v6") / 6).alias("early"), ((F.log1p("v24") - F.log1p("v6")) / 18).alias("mid"), ((F.log1p("v96") - F.log1p("v24")) / 72).alias("late"))


@PLANS.add(_TRAJ + " SELECT user_id, round(early, 6) AS early_velocity, round(late, 6) AS late_velocity, round(mid - early, 6) AS lift, round(-sqrt(((early - (early + mid + late) / 3)**2 + (mid - (early + mid + late) / 3)**2 + (late - (early + mid + late) / 3)**2) / 2), 6) AS stability FROM f")
def trajectory_features(spark, d):
    m = (F.col("early") + F.col("mid") + F.col("late")) / 3
    spread = F.sqrt(sum(F.pow(F.col(c) - m, 2) for c in ("early", "mid", "late")) / 2)
    return _trajectory(spark, d).select("user_id", F.round("early", 6).alias("early_velocity"), F.round("late", 6).alias("late_velocity"), F.round(F.col("mid") - F.col("early"), 6).alias("lift"), F.round(-spread, 6).alias("stability"))


@PLANS.add(_TRAJ + """, t AS (SELECT f.user_id, early * 6 AS early, late * 72 AS late, greatest(0, late * 72) / greatest(1e-6, abs(ln(1 + v24))) AS ratio, -sqrt(((early - (early + mid + late) / 3)**2 + (mid - (early + mid + late) / 3)**2 + (late - (early + mid + late) / 3)**2) / 2) AS s FROM f JOIN p ON f.user_id = p.user_id),
l AS (SELECT user_id, 1.4 * greatest(early, 0) + 0.8 * greatest(-late, 0) + 0.7 * greatest(0, 0.35 - ratio) AS a, greatest(0.05, 1 - abs(early - late) - abs(ratio - 0.5) + 0.2 * greatest(s, 0)) AS b, 1.3 * greatest(late, 0) + 0.9 * greatest(ratio, 0) + 0.5 * greatest(s, 0) AS c FROM t),
e AS (SELECT user_id, exp(a) / (exp(a) + exp(b) + exp(c)) AS spike, exp(b) / (exp(a) + exp(b) + exp(c)) AS balanced, exp(c) / (exp(a) + exp(b) + exp(c)) AS durable FROM l)
SELECT user_id, round(spike, 6) AS spike, round(balanced, 6) AS balanced, round(durable, 6) AS durable, CASE WHEN spike >= balanced AND spike >= durable THEN 'spike' WHEN balanced >= durable THEN 'balanced' ELSE 'durable' END AS regime FROM e""")
def trajectory_regime(spark, d):
    """Regimes by the growth up to 6 hours and after 24, the share of late growth and the spread of the velocities."""
    t = _trajectory(spark, d)
    m = (F.col("early") + F.col("mid") + F.col("late")) / 3
    stability = -F.sqrt(sum(F.pow(F.col(c) - m, 2) for c in ("early", "mid", "late")) / 2)
    late = F.col("late") * 72
    ratio = F.greatest(late, F.lit(0.0)) / F.greatest(F.abs(F.log1p("v24")), F.lit(1e-6))
    p = softmax3(*regime_logits(F.col("early") * 6, late, ratio, stability))
    return t.select("user_id", *[F.round(x, 6).alias(n) for x, n in zip(p, ("spike", "balanced", "durable"), strict=True)], argmax3(*p, names=("spike", "balanced", "durable")).alias("regime"))


@PLANS.add("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-06-01' THEN 'insufficient_history_window' WHEN o_orderdate > TIMESTAMP '2001-06-01' THEN 'label_horizon_not_available'
WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= o_orderdate) THEN 'missing_future_snapshot' ELSE 'included' END AS reason FROM orders) GROUP BY reason""")
def censoring_reasons(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reason = (
        F.when(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp_ntz"), "insufficient_history_window")
        .when(F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp_ntz"), "label_horizon_not_available")
        .when(F.coalesce(F.col("last") < F.col("o_orderdate"), F.lit(True)), "missing_future_snapshot")
        .otherwise("included")
    )
    return o.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_ARR = "SELECT *, ts + to_hours((event_id * 7919) % 120) AS arrived FROM events"


def _arrivals(spark, d):
    return table(spark, d, "events").withColumn("arrived", F.col("ts") + F.make_dt_interval(hours=((F.col("event_id") * 7919) % 120).cast("int")))


@PLANS.add(f"""WITH w AS (SELECT *, max(ts) OVER (PARTITION BY event_type ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM ({_ARR}))
SELECT event_id, CASE WHEN wm IS NULL OR ts >= wm THEN 'on_time' WHEN ts >= wm - INTERVAL 48 HOUR THEN 'late_within_grace' ELSE 'late_out_of_watermark' END AS lateness FROM w""")
def lateness_classes(spark, d):
    return classify_lateness(_arrivals(spark, d), "event_type", "ts", ["arrived", "event_id"]).select("event_id", "lateness")


@PLANS.add("SELECT event_id, lag(event_id) OVER w AS supersedes, lead(event_id) OVER w AS superseded_by FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def supersedes_links_rows(spark, d):
    e = table(spark, d, "events").withColumn("k", F.struct("user_id", "event_type"))
    return supersedes_links(e, "k", "ts", "event_id").select("event_id", "supersedes", "superseded_by")


@PLANS.add("""WITH q AS (SELECT o_orderkey AS query_id, o_custkey AS k, o_orderdate AS t FROM orders), p AS (SELECT query_id, o_orderkey, o_orderdate >= t - INTERVAL 180 DAY AS w FROM q JOIN orders ON k = o_custkey AND o_orderdate < t),
n AS (SELECT query_id, count(*) FILTER (WHERE w) AS c FROM p GROUP BY query_id) SELECT p.query_id, count(*) AS n_pool, max(o_orderkey) AS max_candidate FROM p JOIN n ON p.query_id = n.query_id WHERE w OR c < 2 GROUP BY p.query_id""")
def temporal_pool_sizes(spark, d):
    o = table(spark, d, "orders")
    q = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"))
    return temporal_pool(q, o, [("k", "o_custkey")], "t", "o_orderdate", 180, 2).groupBy("query_id").agg(F.count("*").alias("n_pool"), F.max("o_orderkey").alias("max_candidate"))


@PLANS.add("""SELECT query_id, candidate_id, pos FROM (SELECT q.o_orderkey AS query_id, c.o_orderkey AS candidate_id, row_number() OVER (PARTITION BY q.o_orderkey ORDER BY c.o_orderdate DESC, c.o_orderkey) AS pos
FROM orders q JOIN orders c ON q.o_custkey = c.o_custkey AND c.o_orderdate < q.o_orderdate WHERE q.o_orderstatus = 'P') WHERE pos <= 3""")
def benchmark_case_pool(spark, d):
    o = table(spark, d, "orders")
    q = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"))
    p = q.join(o, (F.col("k") == F.col("o_custkey")) & (F.col("o_orderdate") < F.col("t")))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return p.withColumn("pos", pos).filter("pos <= 3").select("query_id", F.col("o_orderkey").alias("candidate_id"), F.col("pos").cast("long").alias("pos"))


@PLANS.add("""SELECT o_orderkey, o_totalprice / greatest(l, 1) AS rate, CASE WHEN l = 0 THEN 0.0 ELSE o_totalprice / l END AS safe FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) - 10 AS l FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def engagement_rates(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum("l_quantity") - 10).alias("l"))
    j = table(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("o_orderkey", (F.col("o_totalprice") / F.greatest("l", F.lit(1.0))).alias("rate"), safe_div("o_totalprice", "l").alias("safe"))
