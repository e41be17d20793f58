"""Window-style operators: latest row, ranks, links and running state."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an ordered table is cut into.
RANGES = 64


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in ``order``: the DISTINCT ON pattern.

    ``row_number() = 1`` lets Spark prune with WindowGroupLimit before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def order_number(df: DataFrame, column: str) -> Column:
    """A column to order by as a number: times as microseconds."""
    kind = dict(df.dtypes)[column]
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") or kind == "date" else F.col(column).cast("double")


def in_ranges(df: DataFrame, order: str, keys: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Adds ``_range``: the rows of each key cut into about equal ranges of ``order``, equal values in one range.

    With ``_range`` among its keys a window over an ordered table, or over a key with a large
    share of the rows, is spread over tasks. The limits are approximate quantiles, fetched
    once, so that every use of the plan cuts alike; there are ``ranges`` of them per key, and
    the keys (metrics, sources) must be few.
    """
    x = order_number(df, order)
    shares = [i / ranges for i in range(1, ranges)]
    limits = df.select(*keys, x.alias("_x")).groupBy(*keys).agg(F.percentile_approx("_x", shares, 10_000).alias("_limits"))
    if not keys:
        found = limits.first()["_limits"] or []
        cuts = F.array(*[F.lit(v) for v in sorted(set(found))]) if found else F.array().cast("array<double>")
        return df.withColumn("_range", F.size(F.filter(cuts, lambda c: c < x)))
    rows = df.sparkSession.createDataFrame(limits.collect(), limits.schema)
    marked = df.join(F.broadcast(rows.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_limits")), _same(keys), "left")
    return marked.withColumn("_range", F.coalesce(F.size(F.filter("_limits", lambda c: c < x)), F.lit(0))).drop("_limits", *[f"_k{i}" for i in range(len(keys))])


def _same(keys: Sequence[str], prefix: str = "_k") -> Column:
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return cond


def running_before(df: DataFrame, order: str, values: dict[str, tuple[str, str]], keys: Sequence[str] = (), ties: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Adds to each row the sum or maximum of a column over the rows before it, without one task for all rows.

    ``values``: new column -> ("sum" or "max", column). Rows are cut by ``in_ranges``; each
    range has a window of its own and adds what the ranges before it hold, which is one row a
    range. Sums before the first row are 0, maxima null.
    """
    fold = {"sum": F.sum, "max": F.max}
    marked = in_ranges(df, order, keys, ranges)
    per = marked.groupBy(*keys, "_range").agg(*[fold[f](c).alias(f"_per_{n}") for n, (f, c) in values.items()])
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col("_range").alias("_o"), *[fold[f](f"_per_{n}").over(w).alias(f"_off_{n}") for n, (f, _) in values.items()])
    joined = marked.join(F.broadcast(offsets), (F.col("_range") == F.col("_o")) & _same(keys, "_o"))
    here = Window.partitionBy(*keys, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = joined
    for n, (f, c) in values.items():
        now, off = fold[f](c).over(here), F.col(f"_off_{n}")
        out = out.withColumn(n, F.coalesce(now, F.lit(0)) + F.coalesce(off, F.lit(0)) if f == "sum" else F.coalesce(F.greatest(now, off), now, off))
    return out.drop("_range", "_o", *[f"_o{i}" for i in range(len(keys))], *[f"_off_{n}" for n in values])


def chronological_split(df: DataFrame, time: str, tie: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Adds ``split`` by rank in time, at least one row for each split where there are three.

    The rank is not taken by one global sort: rows are counted per time value, the counts
    are summed in time order, and only rows of one time value are ranked against each other.
    """
    total = df.count()
    if total >= 3:
        # shares are decimals: 90,000 rows times 0.7 are 63,000, not the 62,999 of floats
        n_train = min(max(int(total * Decimal(str(train))), 1), total - 2)
        n_val = min(max(int(total * Decimal(str(validation))), 1), total - n_train - 1)
    else:
        n_train, n_val = max(1, total - 1), 0
    per = df.groupBy(F.col(time).alias("_t")).agg(F.count("*").alias("_n"))
    before = running_before(per, "_t", {"_before": ("sum", "_n")}).select("_t", "_before")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(time).orderBy(tie))
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "validation").otherwise("test")
    return df.join(before, F.col(time).eqNullSafe(F.col("_t"))).withColumn("_rank", rank).withColumn("split", split).drop("_t", "_before", "_rank")


def supersedes_links(df: DataFrame, key: str, order: str, ident: str) -> DataFrame:
    """Adds the id of the observation before and after within each entity."""
    w = Window.partitionBy(key).orderBy(order, ident)
    return df.withColumn("supersedes", F.lag(ident).over(w)).withColumn("superseded_by", F.lead(ident).over(w))


def classify_lateness(df: DataFrame, source: str, event: str, arrival: Sequence[str], grace_hours: int = 48) -> DataFrame:
    """Adds ``watermark`` (latest event before the row in arrival order, per source) and ``lateness``.

    Late rows never raise the running maximum, so the maximum over all rows before is exact.
    A source's rows are cut into ranges of the arrival, so one source may hold most rows.
    """
    late = F.when(F.col("watermark").isNull() | (F.col(event) >= F.col("watermark")), "on_time").when(F.col(event) >= F.col("watermark") - F.expr(f"INTERVAL {grace_hours} HOURS"), "late_within_grace").otherwise("late_out_of_watermark")
    marked = running_before(df, arrival[0], {"watermark": ("max", event)}, [source], arrival[1:])
    return marked.withColumn("lateness", late)


def minmax_normalise(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Scores scaled to 0..1 within each group, 0 where the group is constant."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(0.0))


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean, from counts per value, without a sort of all rows in one task."""
    per = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranked = running_before(per, "_v", {"_before": ("sum", "_n")}).select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranked, F.col(value) == F.col("_v")).drop("_v")


def leave_one_out_mean(df: DataFrame, key: str, value: str, split: str, least: int = 2) -> DataFrame:
    """Adds ``baseline``: for train rows the mean of the key's other train rows, for others that of all its train rows,
    and the mean of all train rows where the key has fewer than ``least`` of them, or only the row itself."""
    train = F.col(split) == "train"
    per = df.filter(train).groupBy(key).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    overall = df.filter(train).agg(F.avg(value).alias("_g"))
    n = F.coalesce("_n", F.lit(0)) - F.when(train, 1).otherwise(0)
    enough = (F.coalesce("_n", F.lit(0)) >= least) & (n > 0)
    s = F.coalesce("_s", F.lit(0.0)) - F.when(train, F.col(value)).otherwise(0.0)
    joined = df.join(per, key, "left").crossJoin(F.broadcast(overall))
    return joined.withColumn("baseline", F.when(enough, s / n).otherwise(F.coalesce("_g", F.lit(0.0)))).drop("_s", "_n", "_g")


def trailing_run(df: DataFrame, order: Sequence[Column], flag: Column) -> DataFrame:
    """The number of rows from the newest on that all hold ``flag``; ``df`` is a bounded recent list."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_miss", F.sum(F.when(flag, 0).otherwise(1)).over(w)).agg(F.count_if(F.col("_miss") == 0).alias("trailing"))


def quartile_grades(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Grades 0..3 by the values at places ``round(k * n / 4)`` of each group's sorted values.

    The thresholds come from counts per value and a running sum, not from collected lists.
    """
    per = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    run = per.withColumn("_upto", F.sum("_n").over(Window.partitionBy(group).orderBy(value))).withColumn("_total", F.sum("_n").over(Window.partitionBy(group)))
    place = lambda k: F.least(F.bround(F.col("_total") * k / 4, 0).cast("long"), F.col("_total") - 1)
    cuts = run.groupBy(group).agg(*[F.min(F.when(F.col("_upto") > place(k), F.col(value))).alias(f"_t{k}") for k in (1, 2, 3)])
    grade = sum(F.when(F.col(value) >= F.col(f"_t{k}"), 1).otherwise(0) for k in (1, 2, 3))
    return df.join(cuts, group).withColumn(out, grade).drop("_t1", "_t2", "_t3")
