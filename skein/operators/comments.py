"""Comment features: signals by root, alignment with the post, shrunken priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def comment_signals_by_root(comments: DataFrame, video: str, root: str, level: Column, length: Column, flag: Column) -> DataFrame:
    """Per video: counts, depth, concentration on one root and reply ratio, over two aggregates (root, then video)."""
    r = comments.groupBy(video, root).agg(F.count("*").alias("n"), F.sum(length).alias("len"), F.max(level).alias("depth"), F.count_if(flag).alias("flagged"))
    total = F.sum("n")
    return r.groupBy(video).agg(
        total.alias("n_comments"), F.count("*").alias("n_roots"), F.round(F.sum("len") / total, 6).alias("mean_length"), F.max("depth").alias("depth_max"),
        F.round(F.max("n") / total, 6).alias("root_concentration"), F.round(1 - F.count("*") / total, 6).alias("reply_ratio"), F.round(F.sum("flagged") / total, 6).alias("user_rate"),
    )


def alignment_windows(comments: DataFrame, video: str, order: str, words: str, early: int, on_topic: float) -> DataFrame:
    """Shares of a reply's words that the opening text holds, over all, early and late replies."""
    opening = comments.filter(F.col(order) == 0).select(video, F.col(words).alias("_cw"))
    share = F.size(F.array_intersect(words, "_cw")) / F.greatest(F.size(words), F.lit(1))
    j = comments.filter(F.col(order) > 0).join(opening, video).select(video, F.col(order).alias("o"), share.alias("share"))
    first, late = F.when(F.col("o") <= early, F.col("share")), F.when(F.col("o") > early, F.col("share"))
    return j.groupBy(video).agg(
        F.count("*").alias("n_total"), F.count(first).alias("n_early"), F.round(F.avg("share"), 6).alias("mean_total"), F.round(F.avg(first), 6).alias("mean_early"),
        F.round(F.avg(late), 6).alias("mean_late"), F.round(F.avg((F.col("share") >= on_topic).cast("int")), 6).alias("on_topic"),
    )


def shrunk_priors(rows: DataFrame, keys: Sequence[str], value: str, strength: float, least: int) -> DataFrame:
    """Group means drawn towards the overall mean by ``n / (n + strength)``; groups under ``least`` rows go."""
    overall = rows.agg(F.avg(value).alias("_m"))
    p = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("_raw")).filter(F.col("n") >= least).crossJoin(F.broadcast(overall))
    w = F.col("n") / (F.col("n") + strength)
    return p.select(*keys, "n", F.round(w * F.col("_raw") + (1 - w) * F.col("_m"), 6).alias("prior"))


def overlapping_intents(text: Column, patterns: dict[str, str]) -> Column:
    """Which of several patterns occur, without priority: a map of 0/1, for the lighter signals where intents may overlap."""
    low = F.lower(text)
    return F.create_map(*[x for name, p in patterns.items() for x in (F.lit(name), low.rlike(p).cast("int"))])


def recent(comments: DataFrame, video: str, text: str, at: str, most: int) -> DataFrame:
    """The newest ``most`` comments with text of each video, as a list of (at, text), newest first."""
    w = Window.partitionBy(video).orderBy(F.desc(at), text)
    head = comments.filter(F.trim(F.coalesce(text, F.lit(""))) != "").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(at).alias("at"), F.col(text).alias("text")))), lambda x: F.struct(x["at"].alias("at"), x["text"].alias("text")))
    return head.groupBy(video).agg(listed.alias("comments"))


def reply_counts(snapshots: DataFrame, comment: str, event: str, ingested: str, count: str, as_of: Column) -> DataFrame:
    """The largest reply count per comment among the snapshots that had happened and were known at ``as_of``."""
    return snapshots.filter((F.col(event) <= as_of) & (F.coalesce(ingested, event) <= as_of)).groupBy(comment).agg(F.max(count).alias("reply_count"))


def value_props(words: Column, most: int = 24) -> Column:
    """The most frequent distinct words: each counts once, so the first in alphabetical order."""
    return F.slice(F.array_sort(F.array_distinct(words)), 1, most)


def snapshot_stats(features: DataFrame, covered: Column, late: Column, low: float = 0.35) -> DataFrame:
    """One row over a comment snapshot: coverage, low alignment, mean confidence and volatility, share of late rows."""
    mean = lambda c, name: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return features.agg(
        F.count("*").alias("rows_total"), mean(flag(covered), "coverage_rate"), mean(flag(F.col("alignment_confidence") > 0), "alignment_coverage_rate"), mean(flag(F.coalesce("alignment_score", F.lit(0.0)) < low), "low_alignment_rate"),
        mean(F.col("alignment_confidence"), "alignment_confidence_mean"), mean(F.col("sentiment_volatility"), "sentiment_volatility_mean"), mean(flag(late), "late_share"),
    )
