"""JSON lines: strict and tolerant scans with line numbers, merging, synthetic posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.contracts import RAW


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; blank lines are skipped and a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with 1-based line numbers in each file.

    Text splits carry their byte offset only inside Spark, so lines are numbered by a
    window per file over the order in which the reader yields them; large inputs should
    be many files, which are numbered in parallel.
    """
    raw = spark.read.option("wholetext", False).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    w = Window.partitionBy("file").orderBy("_b", "_i")
    return raw.withColumn("line", F.row_number().over(w).cast("long")).select("file", "line", "value")


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType = RAW) -> tuple[DataFrame, DataFrame]:
    """Good records with their line, and quarantine rows of malformed lines; blank lines are skipped."""
    fields = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", fields, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}))
    good = parsed.filter("r._corrupt is null").select("r.*", "line", "file").drop("_corrupt")
    bad = parsed.filter("r._corrupt is not null").select(F.concat_ws(":", "file", F.col("line").cast("string")).alias("row_key"), F.lit("malformed_json").alias("reason"), F.col("value").alias("detail"), "line")
    return good, bad


def merge_best(spark: SparkSession, paths: list[str], key: str, score: list[str]) -> DataFrame:
    """Files merged: the record of each key with the most filled ``score`` fields, ties to the first; keyless records stay."""
    from skein.operators.upsert import merge_best as best

    parts = [spark.read.json(p).withColumn("_seq", F.struct(F.lit(i).alias("f"), F.monotonically_increasing_id().alias("r"))) for i, p in enumerate(paths)]
    columns = sorted({c for p in parts for c in p.columns})
    parts = [p.select(*[F.col(c) if c in p.columns else F.lit(None).alias(c) for c in columns]) for p in parts]
    filled = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in score)
    return best(parts, key, filled, F.col("_seq")).drop("_seq")


def synthetic_posts(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Deterministic raw posts for tests, generated on the executors from hashes of the row number."""
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(m))
    at = lambda days: F.date_format(F.timestamp_seconds(F.lit(1704067200) + days * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    r = spark.range(n).select("id", h(1, 50).alias("a"), h(2, 60).alias("p"), h(3, 30).alias("s"), h(4, 100000).alias("views"), h(5, 20).alias("tag"))
    comment = lambda i: F.struct(F.concat_ws("-", F.lit("c"), F.col("id").cast("string"), i.cast("string")).alias("comment_id"), F.concat(F.lit("how is it "), i.cast("string")).alias("text"), at(F.col("p") + i).alias("created_at"), i.cast("long").alias("likes"), F.lit(None).cast("string").alias("parent_comment_id"))
    return r.select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("video_id"), F.concat(F.lit("https://example.org/v/"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit("caption #tag"), F.col("tag").cast("string")).alias("caption"), F.array(F.concat(F.lit("#tag"), F.col("tag").cast("string"))).alias("hashtags"), F.array().cast("array<string>").alias("keywords"),
        F.lit(None).cast("string").alias("search_query"), F.lit("en").alias("language"), at(F.col("p")).alias("posted_at"), at(F.col("p") + F.col("s")).alias("scraped_at"), F.lit(None).cast("string").alias("metrics_scraped_at"),
        (F.col("views") / 10).cast("long").alias("likes"), "views", F.lit(3).cast("long").alias("comments_count"), (F.col("views") / 100).cast("long").alias("shares"), F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("source"),
        F.struct(F.concat(F.lit("A"), F.col("a").cast("string")).alias("author_id"), F.concat(F.lit("user"), F.col("a").cast("string")).alias("username"), (F.col("a") * 1000).cast("long").alias("followers")).alias("author"),
        F.struct(F.lit("au1").alias("audio_id"), F.lit("sound").alias("title")).alias("audio"), F.struct((h(6, 120) + 5).cast("int").alias("duration_seconds")).alias("video_meta"),
        F.transform(F.sequence(F.lit(1), F.lit(3)), comment).alias("comments"),
    )
