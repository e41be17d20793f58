"""Experiments: event pivots, variant summaries, comparisons, retrain triggers and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.stats import nearest_rank


def event_pivot(events: DataFrame, key: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Counts of each kind per key, in one aggregate."""
    return events.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds])


def variant_summary(rows: DataFrame, keys: Sequence[str], value: str, flag: str, latency: str) -> DataFrame:
    """Mean value, rate of a flag and nearest-rank p95 of a latency, per variant."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.round(F.avg(F.col(flag).cast("int")), 6).alias("rate"))
    return s.join(nearest_rank(rows, keys, latency, 0.95, "p95"), list(keys))


def variant_comparison(rows: DataFrame, objective: str, variant: str, value: str, treatment: str, control: str, least: int) -> DataFrame:
    """Treatment minus control per objective, with whether there is enough evidence and the verdict."""
    p = rows.groupBy(objective).agg(*[f(F.when(F.col(variant) == v, F.col(value))).alias(f"{k}_{n}") for v, n in ((treatment, "t"), (control, "c")) for k, f in (("n", F.count), ("m", F.avg))])
    delta, enough = F.col("m_t") - F.col("m_c"), F.least("n_t", "n_c") >= least
    verdict = F.when(~enough, "insufficient_evidence").when(delta > 0, "treatment_better").when(delta < 0, "control_better").otherwise("no_difference")
    return p.select(objective, "n_t", "n_c", F.round(delta, 6).alias("delta"), enough.alias("sufficient"), verdict.alias("verdict"))


def retrain_trigger(recent: DataFrame, order: str, severity: str, recommendation: str | None = None, needed: int = 2, scheduled: bool = False, limit: int = 60) -> DataFrame:
    """Whether the newest ``needed`` of the last ``limit`` drift rows are all critical, and the reason.

    With ``recommendation`` a row counts only if it recommends ``retrain_candidate``. Without
    enough critical rows a due schedule triggers. Severities are compared trimmed and in lower
    case, and rows without one are passed over. The list is bounded by ``limit``, so its window
    is one small task.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    last = recent.filter(plain(severity) != "").orderBy(F.desc(order)).limit(limit)
    hit = plain(severity) == "critical"
    if recommendation is not None:
        hit &= plain(recommendation) == "retrain_candidate"
    w = Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    run = last.withColumn("_miss", F.sum(F.when(hit, 0).otherwise(1)).over(w)).agg(F.count_if(F.col("_miss") == 0).alias("trailing_critical"), F.count("*").alias("n_rows"))
    drift = F.col("trailing_critical") >= max(1, needed)
    reason = F.when(drift, "drift_trigger").when(F.lit(scheduled), "scheduled_weekly").otherwise("no_trigger")
    return run.withColumn("triggered", drift | F.lit(scheduled)).withColumn("reason", reason)


def promotion_gate(metrics: DataFrame, checks: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds ``failed`` (names of unmet checks) and ``promote``; a check is (operator, limit), a null metric fails."""
    bad = []
    for name, (op, limit) in checks.items():
        ok = F.col(name) >= limit if op == ">=" else F.col(name) <= limit
        bad.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    failed = F.filter(F.array(*bad), lambda x: x.isNotNull())
    return metrics.withColumn("failed", failed).withColumn("promote", F.size("failed") == 0)


#: The events of a candidate that decide its label.
FEEDBACK = {"saved": ["comparable_saved"], "relevant": ["comparable_marked_relevant"], "not_relevant": ["comparable_marked_not_relevant"], "weak": ["comparable_opened", "comparable_details_opened"]}
#: The priority of each state.
PRIORITY = {"conflict": -1, "saved": 3, "relevant": 2, "not_relevant": 0, "weak_positive": 1, "unlabeled": 1}


def resolve_feedback(events: DataFrame, keys: Sequence[str], kind: str, kinds: dict[str, Sequence[str]] = FEEDBACK) -> DataFrame:
    """State and priority of each key from its set of events, in one aggregate."""
    has = lambda name: F.coalesce(F.bool_or(F.trim(F.col(kind)).isin(list(kinds[name]))), F.lit(False))
    f = events.groupBy(*keys).agg(has("saved").alias("_s"), has("relevant").alias("_r"), has("not_relevant").alias("_n"), has("weak").alias("_w"))
    state = F.when((F.col("_s") | F.col("_r")) & F.col("_n"), "conflict").when(F.col("_s"), "saved").when(F.col("_r"), "relevant").when(F.col("_n"), "not_relevant").when(F.col("_w"), "weak_positive").otherwise("unlabeled")
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("state"))
    return f.select(*keys, state.alias("state")).withColumn("priority", priority)


def pairwise_rows(rows: DataFrame, group: str, item: str, label: str) -> DataFrame:
    """(group, winner, loser) for items of one request with different labels; requests hold bounded slates."""
    a, b = rows.select(group, F.col(item).alias("winner"), F.col(label).alias("_a")), rows.select(group, F.col(item).alias("loser"), F.col(label).alias("_b"))
    return a.join(b, group).filter(F.col("_a") > F.col("_b")).select(group, "winner", "loser", (F.col("_a") - F.col("_b")).alias("margin"))


def preference_profile(events: DataFrame, owner: str, item: str, kind: str, at: str, now, features: DataFrame, kinds: dict[str, Sequence[str]] = FEEDBACK, life: float = 45.0, least: float = 0.1, saved: float = 1.25, author: float = 0.5, top: int = 24) -> DataFrame:
    """Recency-decayed weights of an owner's preferred and avoided features, the heaviest ``top`` of each field.

    ``features``: item, field, token. Each (owner, item) is one entry: entries in conflict or
    without an explicit label are left out, saved ones weigh ``saved`` times as much, and
    tokens of the field ``author`` weigh ``author`` times. ``now``: a timestamp column.
    """
    label = resolve_feedback(events, [owner, item], kind, kinds).filter(F.col("state").isin("saved", "relevant", "not_relevant"))
    entry = label.join(events.groupBy(owner, item).agg(F.max(at).alias("_at")), [owner, item])
    age = F.greatest((F.unix_micros(now) - F.unix_micros(F.col("_at").cast("timestamp"))) / 8.64e10, F.lit(0.0))
    weight = F.greatest(F.exp(-0.6931471805599453 / life * age), F.lit(least)) * F.when(F.col("state") == "saved", saved).otherwise(1.0)
    polarity = F.when(F.col("state") == "not_relevant", "negative").otherwise("positive")
    weighed = entry.select(F.col(owner), F.col(item), polarity.alias("polarity"), weight.alias("_w")).join(features.select(F.col("item").alias(item), "field", "token"), item)
    w = weighed.groupBy(owner, "polarity", "field", "token").agg(F.sum(F.col("_w") * F.when(F.col("field") == "author", author).otherwise(1.0)).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(owner, "polarity", "field").orderBy(F.desc(F.round("weight", 9)), "token"))
    return w.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
