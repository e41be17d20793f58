"""Tag recommendation from neighbours, character n-grams, shortlist pairs, rolling latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.windows import running_before


def neighbour_tags(neighbours: DataFrame, tags: DataFrame, top: int) -> DataFrame:
    """Tags of a query's neighbours, each counting its similarity over its rank.

    ``neighbours``: query, item, score, rank; ``tags``: item, tag, engagement. Returns query,
    tag, frequency, mean engagement, mean similarity, score and rank.
    """
    j = neighbours.join(tags, "item").groupBy("query", "tag").agg(
        F.count("*").alias("frequency"), F.round(F.avg("engagement"), 6).alias("mean_engagement"), F.round(F.avg("score"), 6).alias("mean_similarity"), F.round(F.sum(F.col("score") / F.col("rank")), 6).alias("score")
    )
    w = Window.partitionBy("query").orderBy(F.desc("score"), "tag")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def char_terms(words: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words padded with a space on either side."""
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(n: int) -> Column:
        # a second parameter of the function below would be the place of the word
        return F.flatten(F.transform(padded, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))

    return F.concat(*[of_size(n) for n in range(low, high + 1)])


def shortlist_pairs(rows: DataFrame, query: str, item: str, rank: str, most: int = 50) -> DataFrame:
    """All pairs (first, second) of the head of each shortlist, in rank order."""
    head = rows.filter(F.col(rank) <= most)
    a = head.select(query, F.col(item).alias("first"), F.col(rank).alias("_a"))
    b = head.select(query, F.col(item).alias("second"), F.col(rank).alias("_b"))
    return a.join(b, query).filter(F.col("_a") < F.col("_b")).select(query, "first", "second")


def rolling_latency(rows: DataFrame, key: str, order: str, value: str, size: int = 512, chunk: int = 100_000) -> DataFrame:
    """Mean and largest latency over each row and the ``size - 1`` before it, per key; ``order`` is unique within a key.

    A key's rows are numbered and cut into chunks, each with the rows before it that its first
    windows need, so a key may hold most rows. The keys are few.
    """
    at = running_before(rows.select(key, order, value).withColumn("_one", F.lit(1)), order, {"_pos": ("sum", "_one")}, [key])
    own = F.floor(F.col("_pos") / chunk)
    cut = at.withColumn("_own", own).withColumn("_chunk", F.explode(F.when(F.col("_pos") % chunk >= chunk - (size - 1), F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(-(size - 1), 0)
    out = cut.select(key, order, "_own", "_chunk", F.round(F.avg(value).over(w), 11).alias("mean"), F.max(value).over(w).alias("max"), F.count(value).over(w).alias("n"))
    return out.filter("_own = _chunk").drop("_own", "_chunk")


def write_splits(rows: DataFrame, path: str, split: str, time: str, key: str) -> DataFrame:
    """JSON lines by split; returns counts, bounds and an order-free hash per split."""
    rows.write.mode("overwrite").partitionBy(split).json(path)
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.count_distinct(key).alias("n_keys"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("hash"))
