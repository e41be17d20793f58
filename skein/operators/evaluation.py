"""Ranking quality, diversity and paired bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(rows: DataFrame, query: str, score: str, relevance: str, item: str, k: int) -> DataFrame:
    """NDCG, reciprocal rank and recall at k of each query: gains ``2**rel - 1`` (negative relevance counts as 0), discounts ``log2(rank + 1)``.

    Two rankings (by score and by relevance) are cut at k before their sums.
    """
    got = Window.partitionBy(query).orderBy(F.desc(score), item)
    ideal = Window.partitionBy(query).orderBy(F.desc(relevance), item)
    gain = F.pow(F.lit(2.0), F.greatest(F.col(relevance).cast("double"), F.lit(0.0))) - 1
    r = rows.withColumn("_r", F.row_number().over(got)).withColumn("_i", F.row_number().over(ideal))
    dcg = F.sum(F.when(F.col("_r") <= k, gain / F.log2(F.col("_r") + 1.0)).otherwise(0.0))
    best = F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1.0)).otherwise(0.0))
    hit = (F.col("_r") <= k) & (F.col(relevance) > 0)
    total = F.count_if(F.col(relevance) > 0)
    return r.groupBy(query).agg(
        F.round(F.when(best > 0, dcg / best).otherwise(0.0), 6).alias("ndcg"), F.round(F.coalesce(F.max(F.when(hit, 1.0 / F.col("_r"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.when(total > 0, F.count_if(hit) / total).otherwise(0.0), 6).alias("recall"),
    )


def paired_bootstrap(rows: DataFrame, unit: str, a: str, b: str, samples: int = 200, seed: int = 13) -> DataFrame:
    """Mean lift of b over a with a 95 % interval, by Poisson bootstrap.

    Each unit gets a Poisson(1) count per replicate from a hash, so replicates need no
    resampling shuffle: one aggregate per replicate, all in one pass.
    """
    u = (F.pmod(F.xxhash64(F.col(unit), F.col("rep"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cuts, total, term = [], 0.0, 2.718281828459045**-1
    for i in range(8):
        total += term
        cuts.append(total)
        term /= i + 1
    count = sum(F.when(u >= c, 1).otherwise(0) for c in cuts)
    reps = rows.select(unit, (F.col(b) - F.col(a)).alias("d")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("c", count)
    lift = reps.groupBy("rep").agg((F.sum(F.col("d") * F.col("c")) / F.greatest(F.sum("c"), F.lit(1))).alias("lift"))
    mean = rows.agg(F.avg(F.col(b) - F.col(a)).alias("mean_lift"), F.count("*").alias("n"))
    return lift.agg(F.percentile("lift", F.lit(0.025)).alias("low"), F.percentile("lift", F.lit(0.975)).alias("high")).crossJoin(mean)


def win_rates(rows: DataFrame, query: str, item: str, score: str) -> DataFrame:
    """Share of the other items of its shortlist that each item beats."""
    w = Window.partitionBy(query)
    beaten = F.count("*").over(w.orderBy(score).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.count("*").over(Window.partitionBy(query, score))
    return rows.select(query, item, (beaten / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("win_rate"))


def diversity(rows: DataFrame, group: str, tag: str) -> DataFrame:
    """Distinct tags, mean 3-gram similarity of a list's pairs and the share of redundant pairs (0.45 and more)."""
    from skein.functions.text import tag_jaccard

    a, b = rows.select(group, F.col(tag).alias("_a")).distinct(), rows.select(group, F.col(tag).alias("_b")).distinct()
    s = a.join(b, group).filter("_a < _b").withColumn("s", tag_jaccard("_a", "_b"))
    return s.agg(F.round(F.avg("s"), 6).alias("mean_similarity"), F.round(F.avg((F.col("s") >= 0.45).cast("int")), 6).alias("redundant_rate")).crossJoin(rows.agg(F.count_distinct(tag).alias("n_tags")))
