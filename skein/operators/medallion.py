"""Bronze and silver datasets of an extract, with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import engagement_total, safe_div


def dedupe_latest(df: DataFrame, key: str, stamp: str, seq: str) -> DataFrame:
    """The row with the greatest time text per key, ties to the later row."""
    w = Window.partitionBy(key).orderBy(F.desc(F.coalesce(F.col(stamp).cast("string"), F.lit(""))), F.desc(seq))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def silver_videos(bronze: DataFrame, seq: str = "line") -> DataFrame:
    v = dedupe_latest(bronze, "video_id", "scraped_at", seq)
    tags = F.array_sort(F.array_distinct(F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))))
    total = engagement_total("likes", "comments_count", "shares")
    return v.select("video_id", F.col("author.author_id").alias("author_id"), "caption", tags.alias("hashtags"), "views", "likes", "comments_count", "shares", total.alias("engagement_total"), F.round(safe_div(total, "views"), 6).alias("engagement_rate"), "scraped_at")


def silver_comments(bronze: DataFrame, seq: str = "line") -> DataFrame:
    c = bronze.select("video_id", seq, F.explode("comments").alias("c")).select("video_id", seq, "c.*")
    return dedupe_latest(c.filter("comment_id is not null"), "comment_id", "created_at", seq).select("comment_id", "video_id", "text", "likes", F.length("text").alias("text_length"), "created_at")


def silver_authors(bronze: DataFrame, seq: str = "line") -> DataFrame:
    a = bronze.select("author.*", "scraped_at", seq).filter("author_id is not null")
    return dedupe_latest(a, "author_id", "scraped_at", seq).select("author_id", "username", "followers")


def silver_full(bronze: DataFrame, seq: str = "line") -> DataFrame:
    """Videos with their author and number of comments."""
    v, a, c = silver_videos(bronze, seq), silver_authors(bronze, seq), silver_comments(bronze, seq)
    n = c.groupBy("video_id").agg(F.count("*").alias("n_comments"))
    return v.join(a, "author_id", "left").join(n, "video_id", "left").fillna(0, ["n_comments"])


def lineage_record(name: str, df: DataFrame, inputs: list[str]) -> dict:
    return {"dataset": name, "inputs": inputs, "columns": df.columns, "schema": df.schema.simpleString()}
