"""Whole builds over the driver tables, mapped to canonical entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import datamart as D
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()


def _bundle(spark, d):
    """Events of a user as snapshots of a video first seen at sign-up; the customer's segment is its topic."""
    e = table(spark, d, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    first = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("event_time").alias("posted_at"))
    c = table(spark, d, "customer")
    v = first.join(c, F.col("user_id") == F.col("c_custkey"))
    return {
        "videos": v.select(F.col("user_id").cast("string").alias("video_id"), F.col("c_nationkey").cast("string").alias("author_id"), F.concat_ws(" ", "c_mktsegment", F.col("c_name")).alias("caption"), F.array(F.lower("c_mktsegment")).alias("hashtags"), F.lit(None).cast("string").alias("search_query"), "posted_at"),
        "video_snapshots": e.select(F.col("user_id").cast("string").alias("video_id"), "event_time", F.col("event_id").cast("string").alias("video_snapshot_id"), (F.col("value") * 100).cast("long").alias("views"), F.col("value").cast("long").alias("likes"), (F.col("event_id") % 7).alias("comments_count"), (F.col("event_id") % 3).alias("shares")),
        "authors": c.select(F.col("c_nationkey").cast("string").alias("author_id"), F.col("c_acctbal").cast("long").alias("followers")),
    }


_CONFIG = D.Config(run_at="2024-01-31")
_MARKS = {"t0": 0, "t6": 6, "t24": 24, "t96": 96}


def _series(objective: str, t: str) -> str:
    return {"reach": f"ln(1 + {t}.views)", "engagement": f"({t}.likes + {t}.comments + {t}.shares) / greatest({t}.views, 1)", "conversion": f"{t}.shares * 1000 / greatest({t}.views, 1)"}[objective]


def _sum(parts: list[str]) -> str:
    return " + ".join(f"coalesce({p}, 0)" for p in parts)


def _rows_sql() -> str:
    """CTEs up to z: the finished rows, written from the definitions of labels, features and z-scores."""
    objectives = list(D.OBJECTIVES)
    comps = lambda o: f"round(({o}_t6 - {o}_t0) / 6, 6) AS {o}_early_velocity, round(({o}_t24 - {o}_t6) / 18, 6) AS {o}_core_velocity, round({o}_t96 - {o}_t24, 6) AS {o}_late_lift, round(({o}_t96 - {o}_t24) / 72, 6) AS {o}_last"
    m = lambda o: f"(({o}_early_velocity + {o}_core_velocity + {o}_last) / 3)"
    spread = lambda o: "round(-sqrt((" + " + ".join(f"power({o}_{c} - {m(o)}, 2)" for c in ("early_velocity", "core_velocity", "last")) + f") / 2), 6) + 0.0 AS {o}_stability"
    mean = lambda c: f"(({_sum([f'{o}_{c}' for o in objectives])}) / 3.0)"
    count = " + ".join(f"({o}_{c} IS NOT NULL)::INT" for o in objectives for c in D.COMPONENTS)
    composite = lambda o: f"{o}_early_velocity * 0.45::DOUBLE + {o}_stability * 0.20::DOUBLE + {o}_late_lift * 0.35::DOUBLE AS {o}_composite"
    scored = [f"y_{o}" for o in objectives] + [f"{o}_{c}" for o in objectives for c in (*D.COMPONENTS, "composite")] + ["tr_stability", "tr_durability_ratio"]
    reach = [f"coalesce(reach_{t}, 0)" for t in _MARKS]
    return f"""v AS (SELECT user_id, c_nationkey, lower(c_mktsegment) AS topic_key, c_mktsegment || ' ' || c_name AS caption, t0 + INTERVAL 24 HOUR AS as_of FROM (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY user_id) JOIN customer ON c_custkey = user_id),
a AS (SELECT c_nationkey, max(trunc(c_acctbal)::BIGINT) AS followers FROM customer GROUP BY c_nationkey),
e AS (SELECT user_id, ts, (ts, event_id::VARCHAR) AS k, {{'views': greatest(trunc(value * 100)::BIGINT, 0), 'likes': greatest(trunc(value)::BIGINT, 0), 'comments': event_id % 7, 'shares': event_id % 3}} AS s FROM events),
p AS (SELECT v.*, arg_max(s, k) FILTER (WHERE ts <= as_of) AS pre, arg_min(s, k) FILTER (WHERE ts >= as_of + INTERVAL 72 HOUR AND ts <= TIMESTAMP '2024-01-31') AS future, {", ".join(f"arg_max(s, k) FILTER (WHERE ts <= as_of + INTERVAL {h} HOUR AND ts <= TIMESTAMP '2024-01-31') AS {t}" for t, h in _MARKS.items())} FROM v JOIN e ON v.user_id = e.user_id GROUP BY ALL),
x AS (SELECT *, CASE WHEN as_of >= TIMESTAMP '2024-01-31' THEN 'insufficient_history_window' WHEN as_of + INTERVAL 72 HOUR > TIMESTAMP '2024-01-31' THEN 'label_horizon_not_available' WHEN future IS NULL THEN 'missing_future_snapshot' END AS reason FROM p),
s0 AS (SELECT user_id::VARCHAR AS video_id, c_nationkey, topic_key, caption, as_of, ln(1 + greatest(future.views - coalesce(pre.views, 0), 0)) AS y_reach, ln(1 + (future.likes + future.comments + future.shares) / greatest(future.views, 1)) AS y_engagement, ln(1 + future.shares * 1000 / greatest(future.views, 1)) AS y_conversion, ln(1 + future.views) AS log_views,
{", ".join(f"round({_series(o, t)}, 6) AS {o}_{t}" for o in objectives for t in _MARKS)} FROM x WHERE reason IS NULL),
s1 AS (SELECT *, {", ".join(comps(o) for o in objectives)} FROM s0),
s2 AS (SELECT *, {", ".join(spread(o) for o in objectives)} FROM s1),
s3 AS (SELECT *, {", ".join(f"{mean(c)} AS m_{c}" for c in D.COMPONENTS)}, {", ".join(composite(o) for o in objectives)}, {count} AS flags FROM s2),
s4 AS (SELECT *, greatest(m_late_lift, 0) / greatest(abs({reach[2]} - {reach[0]}), 1e-6) AS ratio FROM s3),
s5 AS (SELECT *, 1.4 * greatest(m_early_velocity, 0) + 0.8 * greatest(-m_late_lift, 0) + 0.7 * greatest(0, 0.35 - ratio) AS la, greatest(0.05, 1 - abs(m_early_velocity - m_late_lift) - abs(ratio - 0.5) + 0.2 * greatest(m_stability, 0)) AS lb, 1.3 * greatest(m_late_lift, 0) + 0.9 * greatest(ratio, 0) + 0.5 * greatest(m_stability, 0) AS lc FROM s4),
s6 AS (SELECT *, round(exp(la - greatest(la, lb, lc)) / (exp(la - greatest(la, lb, lc)) + exp(lb - greatest(la, lb, lc)) + exp(lc - greatest(la, lb, lc))), 6) AS spike, round(exp(lb - greatest(la, lb, lc)) / (exp(la - greatest(la, lb, lc)) + exp(lb - greatest(la, lb, lc)) + exp(lc - greatest(la, lb, lc))), 6) AS balanced, round(exp(lc - greatest(la, lb, lc)) / (exp(la - greatest(la, lb, lc)) + exp(lb - greatest(la, lb, lc)) + exp(lc - greatest(la, lb, lc))), 6) AS durable,
row_number() OVER (ORDER BY as_of, video_id || '::' || strftime(as_of, '%Y-%m-%dT%H:%M:%S')) AS r, count(*) OVER () AS n, round(m_stability, 6) AS tr_stability, round(ratio, 6) AS tr_durability_ratio FROM s5),
s7 AS (SELECT *, least(greatest(floor(n * 0.70), 1), n - 2) AS tn, list_sort([spike, balanced, durable]) AS ps FROM s6),
s8 AS (SELECT *, CASE WHEN r <= tn THEN 'train' WHEN r <= tn + least(greatest(floor(n * 0.15), 1), n - tn - 1) THEN 'validation' ELSE 'test' END AS split FROM s7),
st AS (SELECT {", ".join(f"avg({c}) AS a_{c}, coalesce(stddev_samp({c}), 0) AS d_{c}" for c in scored)}, avg(log_views) AS overall FROM s8 WHERE split = 'train'),
au AS (SELECT c_nationkey, sum(log_views) AS total, count(*) AS c FROM s8 WHERE split = 'train' GROUP BY c_nationkey),
z AS (SELECT s8.*, {", ".join(f"CASE WHEN d_{c} = 0 THEN 0 ELSE ({c} - a_{c}) / d_{c} END AS {c}_z" for c in scored)}, CASE greatest(spike, balanced, durable) WHEN spike THEN 'spike' WHEN balanced THEN 'balanced' ELSE 'durable' END AS regime,
CASE {reach[0]} WHEN greatest({", ".join(reach)}) THEN 0 ELSE CASE {reach[1]} WHEN greatest({", ".join(reach)}) THEN 6 ELSE CASE {reach[2]} WHEN greatest({", ".join(reach)}) THEN 24 ELSE 96 END END END AS peak,
CASE WHEN followers < 10000 THEN 'nano' WHEN followers < 100000 THEN 'micro' WHEN followers < 1000000 THEN 'macro' ELSE 'mega' END AS author_size, log_views - CASE WHEN coalesce(c, 0) < 2 THEN overall WHEN split = 'train' THEN (total - log_views) / (c - 1) ELSE total / c END AS residual
FROM s8 JOIN a ON a.c_nationkey = s8.c_nationkey LEFT JOIN au ON au.c_nationkey = s8.c_nationkey, st)"""


_ROWS = _rows_sql()


@PLANS.add(f"""WITH {_ROWS} SELECT video_id, topic_key, split, author_size, regime, round(y_reach_z, 6) AS y_reach_z, round(y_conversion_z, 6) AS y_conversion_z, reach_early_velocity, engagement_late_lift, conversion_stability, round(reach_composite_z, 6) AS reach_composite_z, round(engagement_stability_z, 6) AS engagement_stability_z,
round(m_core_velocity - m_early_velocity, 6) AS acceleration, tr_durability_ratio, round(tr_stability_z, 6) AS tr_stability_z, peak::DOUBLE AS peak_lag_hours, round(flags / 12.0, 6)::DOUBLE AS available_ratio, round(ps[3] - ps[2], 6) AS regime_confidence, round(residual, 6) AS residual FROM z""")
def datamart_rows(spark, d):
    r = D.build(_bundle(spark, d), _CONFIG, ["rows"])["rows"]
    return r.select(
        "video_id", "topic_key", "split", "author_size", "regime", F.round("y_reach_z", 6).alias("y_reach_z"), F.round("y_conversion_z", 6).alias("y_conversion_z"), "reach_early_velocity", "engagement_late_lift", "conversion_stability", F.round("reach_composite_z", 6).alias("reach_composite_z"), F.round("engagement_stability_z", 6).alias("engagement_stability_z"),
        F.col("tr_acceleration_proxy").alias("acceleration"), "tr_durability_ratio", F.round("tr_stability_z", 6).alias("tr_stability_z"), F.col("tr_peak_lag_hours").alias("peak_lag_hours"), F.col("tr_available_ratio").alias("available_ratio"), F.col("tr_regime_confidence").alias("regime_confidence"), F.col("residual_log_views").alias("residual"),
    )


_WORDS = "list_filter(string_split_regex(regexp_replace(lower(caption), '[#,./?!-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2)"


def _pairs_sql(score: str, asked: str) -> str:
    per = " UNION ALL ".join(f"SELECT query_id, candidate_id, similarity, '{o}' AS objective, {score.format(o=o)} AS score FROM h JOIN z ON z.video_id = candidate_id JOIN z q ON q.video_id = query_id WHERE {asked.format(o=o)}" for o in D.OBJECTIVES)
    return f"""WITH {_ROWS}, t AS (SELECT video_id, as_of, list_distinct(list_concat({_WORDS}, [topic_key])) AS w FROM z),
j AS (SELECT q.video_id AS query_id, c.video_id AS candidate_id, len(list_intersect(q.w, c.w)) / len(list_distinct(list_concat(q.w, c.w))) AS similarity FROM t q JOIN t c ON c.as_of < q.as_of),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, candidate_id) AS r FROM j WHERE similarity > 0) WHERE r <= 8), o AS ({per})
SELECT query_id, candidate_id, round(similarity, 6) AS similarity, objective, CASE WHEN score >= 1 THEN 3 WHEN score >= 0.3 THEN 2 WHEN score >= -0.3 THEN 1 ELSE 0 END AS relevance_label FROM o WHERE score IS NOT NULL"""


_PAIR_COLUMNS = ("query_id", "candidate_id", "similarity", "objective", "relevance_label")


@PLANS.add(_pairs_sql("z.y_{o}_z", "true"))
def datamart_pairs(spark, d):
    return D.build(_bundle(spark, d), _CONFIG)["pairs"].select(*_PAIR_COLUMNS)


@PLANS.add(_pairs_sql("z.{o}_composite_z", "q.{o}_composite IS NOT NULL"))
def datamart_trajectory_pairs(spark, d):
    """Pairs by the composite trajectory targets; objectives that are not available have none."""
    return D.build(_bundle(spark, d), D.Config(run_at="2024-01-31", target_source="trajectory_v2_composite"))["pairs"].select(*_PAIR_COLUMNS)


@PLANS.add(f"""WITH {_ROWS} SELECT coalesce(reason, 'included') AS reason, count(*) AS n FROM x GROUP BY 1""")
def datamart_exclusions(spark, d):
    return D.build(_bundle(spark, d), _CONFIG, ["stats"])["stats"]


@PLANS.add("WITH " + _ROWS + ", o AS (" + " UNION ALL ".join(f"SELECT '{o}' AS objective, split, {o}_composite IS NOT NULL AS there FROM z" for o in D.OBJECTIVES) + ") SELECT objective, split, count(*) AS rows, count(*) FILTER (WHERE there) AS available, round(avg(there::INT), 6) AS rate FROM o GROUP BY ALL")
def datamart_availability(spark, d):
    return D.build(_bundle(spark, d), _CONFIG, ["availability"])["availability"]
