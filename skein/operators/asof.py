"""As-of joins over bitemporal snapshots, horizons and temporal candidate pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], at: Column, event: str, tie: str, columns: Sequence[str], direction: str = "backward", ingested: str | None = None, known_by: Column | None = None, tolerance: str | None = None) -> DataFrame:
    """Each left row with the latest right row at or before ``at`` (or the earliest at or after it).

    Both sides are put into one table, sorted within (key, day), and the last right row is
    carried along, so no left row meets a key's whole history and a hot key is spread over its
    days; the last row of the days before comes from one row per key and day. Ties of the
    event time go to the larger ``tie`` (the smaller one forward).

    ``ingested``/``known_by`` hide rows that were not known yet, which differs by left row: then
    an equi join and one ``max_by``/``min_by`` per left row, which needs a column ``row_id``.
    Without a match the columns are null.
    """
    back = direction == "backward"
    if ingested is not None:
        ok = (F.col(event) <= at if back else F.col(event) >= at) & (F.col(ingested) <= known_by)
        if tolerance is not None:
            ok &= (F.col(event) >= at - F.expr(f"INTERVAL {tolerance}")) if back else (F.col(event) <= at + F.expr(f"INTERVAL {tolerance}"))
        cond = ok
        for a, b in keys:
            cond &= F.col(a) == F.col(b)
        pick = (F.max_by if back else F.min_by)(F.struct(*columns), F.struct(event, tie))
        best = left.join(right, cond, "inner").groupBy("row_id").agg(pick.alias("_m"))
        return left.join(best, "row_id", "left").select(*left.columns, *[F.col(f"_m.{c}").alias(c) for c in columns])
    names = [f"_k{i}" for i in range(len(keys))]
    found = F.struct(*columns, F.col(event).alias("_event"))
    r = right.select(*[F.col(b).alias(n) for n, (_, b) in zip(names, keys, strict=True)], F.col(event).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), found.alias("_found")).filter("_t is not null")
    shape = dict(zip(r.columns, r.schema, strict=True))
    none = lambda c: F.lit(None).cast(shape[c].dataType)
    own = left.select(*[F.col(a).alias(n) for n, (a, _) in zip(names, keys, strict=True)], at.alias("_t"), F.lit(1).alias("_side"), none("_tie").alias("_tie"), none("_found").alias("_found"), F.struct(*left.columns).alias("_row"))
    both = r.withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)).unionByName(own).withColumn("_day", F.to_date("_t"))
    way = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    in_day = Window.partitionBy(*names, "_day").orderBy(way("_t"), "_side", way("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_found", ignorenulls=True).over(in_day)).filter("_side = 1")
    ends = both.groupBy(*names, "_day").agg((F.max_by if back else F.min_by)("_found", F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_end"))
    days = Window.partitionBy(*names).orderBy(way("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*[F.col(n).alias(f"{n}b") for n in names], F.col("_day").alias("_dayb"), F.last("_end", ignorenulls=True).over(days).alias("_before"))
    same = F.col("_day").eqNullSafe(F.col("_dayb"))
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"{n}b"))
    got = F.when(F.col("_t").isNotNull(), F.coalesce("_here", "_before"))
    for n in names:
        got = F.when(F.col(n).isNotNull(), got)
    out = here.join(before, same, "left").withColumn("_m", got)
    if tolerance is not None:
        near = F.col("_m._event") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}") if back else F.col("_m._event") <= F.col("_t") + F.expr(f"INTERVAL {tolerance}")
        out = out.withColumn("_m", F.when(near, F.col("_m")))
    return out.select("_row.*", *[F.col(f"_m.{c}").alias(c) for c in columns])


def resolve_boundaries(anchors: DataFrame, snapshots: DataFrame, key: str, anchor: str, event: str, value: str, hours: Sequence[int], late: str | None = None) -> DataFrame:
    """Earliest snapshot at or after each of several hours from the anchor, with the reason where there is none.

    One row per anchor and hour: key, hour, value, reason. Snapshots flagged ``late`` do not
    count and give the reason ``late_data``.
    """
    marks = anchors.select(key, F.col(anchor).alias("_t"), F.explode(F.array(*[F.lit(h) for h in hours])).alias("hour"))
    due = F.col("_t") + F.make_dt_interval(hours=F.col("hour"))
    usable = ~F.col(late) if late else F.lit(True)
    after = F.col(event) >= due
    joined = marks.join(snapshots, key, "left")
    got = joined.groupBy(key, "hour").agg(
        F.min_by(F.when(after & usable, F.col(value)), F.when(after & usable, F.struct(event, value))).alias("value"),
        F.count(event).alias("_any"),
        F.count(F.when(after, 1)).alias("_after"),
    )
    reason = F.when(F.col("value").isNotNull(), None).when(F.col("_any") == 0, "no_snapshots").when(F.col("_after") == 0, "missing_future_snapshot").otherwise("late_data")
    return got.select(key, "hour", "value", reason.alias("reason"))


def temporal_pool(queries: DataFrame, candidates: DataFrame, on: Sequence[tuple[str, str]], q_time: str, c_time: str, days: int, least: int) -> DataFrame:
    """Candidates in ``[query - days, query)``, or all earlier ones where fewer than ``least`` are in the window.

    Queries need ``query_id``. The equi keys keep the join from being a product.
    """
    cond = F.col(c_time) < F.col(q_time)
    for a, b in on:
        cond &= F.col(a) == F.col(b)
    pairs = queries.join(candidates, cond).withColumn("in_window", F.col(c_time) >= F.col(q_time) - F.expr(f"INTERVAL {days} DAYS"))
    enough = pairs.groupBy("query_id").agg(F.count_if("in_window").alias("n_window"))
    return pairs.join(enough, "query_id").filter(F.col("in_window") | (F.col("n_window") < least))


def classify_outcome(served: Column, window_hours: int, run_at: Column, ingested: Column) -> Column:
    """Censorship reason of an outcome, null where it is resolved. ``ingested``: when its snapshot was, null without one."""
    due = served + F.expr(f"INTERVAL {window_hours} HOURS")
    return F.when(due > run_at, f"not_matured_{window_hours}h").when(ingested.isNull(), "missing_snapshot").when(ingested > run_at, "ingested_after_cutoff")
