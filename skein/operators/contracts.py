"""Canonical records: normalisation, merge folds, quality, validation and quarantine."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import safe_strip

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()

#: Schema of a raw post record.
RAW = _struct(
    id=_S, video_id=_S, url=_S, caption=_S, hashtags=T.ArrayType(_S), keywords=T.ArrayType(_S), search_query=_S, language=_S, posted_at=_S, scraped_at=_S, metrics_scraped_at=_S,
    likes=_L, views=_L, comments_count=_L, shares=_L, source=_S, author=_struct(author_id=_S, username=_S, followers=_L), audio=_struct(audio_id=_S, title=_S),
    video_meta=_struct(duration_seconds=_I), comments=T.ArrayType(_struct(comment_id=_S, text=_S, created_at=_S, likes=_L, parent_comment_id=_S)),
)


def with_quality(df: DataFrame, reasons: dict[str, Column], cost: float) -> DataFrame:
    """Adds quality_reasons, quality_score (``cost`` less per reason) and quality_tier."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()]), lambda x: x.isNotNull())
    df = df.withColumn("quality_reasons", found).withColumn("quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cost * F.size("quality_reasons"))), 6))
    tier = F.when(F.col("quality_score") >= 0.85, "gold").when(F.col("quality_score") >= 0.65, "silver").when(F.col("quality_score") >= 0.4, "bronze").otherwise("quarantine")
    return df.withColumn("quality_tier", tier)


def video_quality(df: DataFrame) -> DataFrame:
    d = F.col("duration_seconds")
    blank = F.trim(F.coalesce("caption", F.lit(""))) == ""
    reasons = {
        "missing_caption": blank, "missing_duration_seconds": d.isNull(), "missing_language": F.coalesce("language", F.lit("")) == "",
        "missing_video_url": F.coalesce("video_url", F.lit("")) == "", "long_duration_outlier": d > 180, "short_duration_outlier": d < 5,
    }
    return with_quality(df, reasons, 0.12).withColumn("required_fields_ok", ~(blank & d.isNull()))


def normalise_records(raw: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """Raw posts as canonical entities: authors, videos, video_snapshots, comments.

    ``raw`` has the ``RAW`` columns and ``line`` (arrival order). Authors are keyed by lower-case
    id, else username; snapshot time is scraped_at, else metrics_scraped_at, else ``as_of``.
    """
    at = F.lit(as_of).cast("timestamp")
    video = F.coalesce(safe_strip("video_id"), safe_strip("id"))
    author = F.lower(F.coalesce(safe_strip("author.author_id"), safe_strip("author.username"), F.lit("unknown")))
    event = F.coalesce(F.try_to_timestamp("scraped_at"), F.try_to_timestamp("metrics_scraped_at"), at)
    base = raw.filter(video.isNotNull()).select("*", video.alias("_v"), author.alias("_a"), event.alias("_t"))
    tags = F.array_distinct(F.transform(F.filter("hashtags", lambda t: F.trim(t) != ""), lambda t: F.concat(F.lit("#"), F.lower(F.ltrim(F.trim(t), F.lit("#"))))))
    snap = F.concat_ws("::", "_v", F.date_format("_t", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("line").cast("string"))
    videos = base.select(F.col("_v").alias("video_id"), F.col("_a").alias("author_id"), "caption", F.coalesce(tags, F.array().cast("array<string>")).alias("hashtags"), "keywords", "search_query", F.try_to_timestamp("posted_at").alias("posted_at"), F.col("url").alias("video_url"), "audio.audio_id", "video_meta.duration_seconds", "language", F.col("_t").alias("seen_at"), "source", "line")
    comments = base.select("_v", "source", "line", "_t", F.posexplode_outer("comments").alias("pos", "c")).filter("c is not null")
    return {
        "authors": base.select(F.col("_a").alias("author_id"), "author.username", "author.followers", F.col("_t").alias("seen_at"), "source", "line"),
        "videos": video_quality(videos),
        "video_snapshots": base.select(snap.alias("video_snapshot_id"), F.col("_v").alias("video_id"), F.col("_t").alias("event_time"), at.alias("ingested_at"), *[F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).alias(c) for c in ("views", "likes", "comments_count", "shares")], "source", "line"),
        "comments": comments.select(F.coalesce(safe_strip("c.comment_id"), F.sha1(F.concat_ws("|", "_v", "c.text", F.col("pos").cast("string")))).alias("comment_id"), F.col("_v").alias("video_id"), "c.text", "c.parent_comment_id", F.coalesce(F.try_to_timestamp("c.created_at"), F.col("_t")).alias("created_at"), "c.likes", "source", "line"),
    }


def merge_latest(df: DataFrame, key: str, seen: str, seq: str, columns: Sequence[str], largest: Sequence[str] = (), smallest: Sequence[str] = ()) -> DataFrame:
    """One row per key: the latest non-empty value of each column, and the extremes of others; one aggregate."""

    def latest(c: str) -> Column:
        full = F.col(c).isNotNull() if not isinstance(df.schema[c].dataType, T.StringType) else F.col(c).isNotNull() & (F.trim(c) != "")
        return F.max_by(F.when(full, F.col(c)), F.when(full, F.struct(seen, seq))).alias(c)

    return df.groupBy(key).agg(*[latest(c) for c in columns], *[F.max(c).alias(c) for c in largest], *[F.min(c).alias(c) for c in smallest])


def missing_keys(child: DataFrame, column: str, parent: DataFrame, parent_key: str, entity: str) -> DataFrame:
    """Rows whose reference is missing: (entity, id, reason)."""
    bad = child.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")
    return bad.select(F.lit(entity).alias("entity"), F.col(column).cast("string").alias("id"), F.lit(f"missing_{parent_key}").alias("reason"))


def duplicate_ids(df: DataFrame, key: str, entity: str) -> DataFrame:
    d = df.groupBy(key).count().filter("count > 1")
    return d.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), F.lit("duplicate_id").alias("reason"))


def after_as_of(df: DataFrame, key: str, times: Sequence[str], as_of: str, entity: str) -> DataFrame:
    """Rows with a time after ``as_of``; a valid bundle has none."""
    late = reduce(lambda a, b: a | b, [F.coalesce(F.col(t) > F.lit(as_of).cast("timestamp"), F.lit(False)) for t in times])
    return df.filter(late).select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), F.lit("after_as_of_time").alias("reason"))


def validate_bundle(b: dict[str, DataFrame], as_of: str) -> DataFrame:
    """All violations of a bundle of canonical entities."""
    found = [
        duplicate_ids(b["authors"], "author_id", "author"), duplicate_ids(b["videos"], "video_id", "video"), duplicate_ids(b["video_snapshots"], "video_snapshot_id", "video_snapshot"), duplicate_ids(b["comments"], "comment_id", "comment"),
        missing_keys(b["videos"], "author_id", b["authors"], "author_id", "video"), missing_keys(b["video_snapshots"], "video_id", b["videos"], "video_id", "video_snapshot"), missing_keys(b["comments"], "video_id", b["videos"], "video_id", "comment"),
        after_as_of(b["videos"], "video_id", ["posted_at"], as_of, "video"), after_as_of(b["video_snapshots"], "video_snapshot_id", ["event_time"], as_of, "video_snapshot"), after_as_of(b["comments"], "comment_id", ["created_at"], as_of, "comment"),
    ]
    return reduce(DataFrame.unionByName, found)


#: Columns that a pre-publication track may not read.
COMMENT_COLUMNS = ("comments", "comments_count", "comment_features", "comment_intelligence")


def guard_track(df: DataFrame, track: str) -> DataFrame:
    """Refuses a plan that reads comment columns before publication."""
    if track == "pre_publication" and (bad := sorted(set(df.columns) & set(COMMENT_COLUMNS))):
        raise ValueError(f"track pre_publication may not read {bad}")
    return df


def required_columns(df: DataFrame, columns: Sequence[str], nulls_count: bool = True) -> DataFrame:
    """(column, problem, rows) for columns that are absent, or hold nulls where these count."""
    spark = df.sparkSession
    absent = [(c, "missing", 0) for c in columns if c not in df.columns]
    out = spark.createDataFrame(absent, "column string, problem string, rows long")
    here = [c for c in columns if c in df.columns]
    if nulls_count and here:
        n = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in here])
        rows = n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("null").alias("problem"), F.col(c).alias("rows")) for c in here])).alias("r")).select("r.*")
        out = out.unionByName(rows.filter("rows > 0"))
    return out


def sanitise(df: DataFrame, column: str, forbidden: Sequence[str], longest: int = 256, items: int = 64) -> DataFrame:
    """A map column without forbidden keys, long values cut to ``longest - 4`` characters and an ellipsis, at most ``items`` entries."""
    kept = F.map_filter(F.col(column), lambda k, v: ~F.lower(k).isin([f.lower() for f in forbidden]))
    cut = F.transform_values(kept, lambda k, v: F.when(F.length(v) > longest, F.concat(F.substring(v, 1, longest - 4), F.lit("..."))).otherwise(v))
    return df.withColumn(column, F.map_from_entries(F.slice(F.map_entries(cut), 1, items)))


def validate_posts(raw: DataFrame, now: str) -> DataFrame:
    """Adds ``errors`` to raw posts: negative counts, too few comments, future times, malformed tags or language."""
    t = F.lit(now).cast("timestamp")
    checks = {
        "negative_count": F.least(*[F.coalesce(c, F.lit(0)) for c in ("likes", "views", "comments_count", "shares")]) < 0,
        "too_few_comments": F.size(F.coalesce("comments", F.array().cast(raw.schema["comments"].dataType))) < 3,
        "future_time": F.coalesce(F.try_to_timestamp("posted_at") > t, F.lit(False)) | F.coalesce(F.try_to_timestamp("scraped_at") > t, F.lit(False)),
        "bad_hashtag": F.exists(F.coalesce("hashtags", F.array().cast("array<string>")), lambda h: ~h.rlike(r"^#?\w+$")),
        "bad_language": F.col("language").isNotNull() & ~F.col("language").rlike(r"^[a-z]{2}(-[A-Z]{2})?$"),
    }
    return raw.withColumn("errors", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()))
