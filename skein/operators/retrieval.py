"""Retrieval and reranking: exact vector search, fusion, relaxed constraints, greedy selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import materialise

#: Default shares of the retrieval branches, and what agreeing branches add.
BLEND = {"semantic": 0.45, "hashtag": 0.30, "structured": 0.25}
AGREEMENT = {2: 0.04, 3: 0.08}
#: Queries that go to the workers at once.
QUERY_BLOCK = 2048


def exact_topk(items: DataFrame, queries: DataFrame, item_id: str, query_id: str, vector: str, k: int, cosine: bool = True, skip_same: bool = True) -> DataFrame:
    """(query, item, score, rank) of the k best items of each query, by brute force in blocks.

    A bounded block of queries is sent to the workers, each of which keeps the k best of its
    rows, so a pass moves k rows a query and partition. Larger query sets take more passes.
    """
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == i)
        rows = part.select(F.col(query_id).cast("long").alias("q"), vector).orderBy("q").collect()
        if not rows:
            continue
        ids = np.array([r["q"] for r in rows])
        q = np.array([r[vector] for r in rows], float)
        if cosine:
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def best(batches: Iterator[pa.RecordBatch], ids=ids, q=q) -> Iterator[pa.RecordBatch]:
            top_s, top_i = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                if cosine:
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                own = b.column(0).to_numpy(zero_copy_only=False)
                s = q @ x.T
                if skip_same:
                    s[ids[:, None] == own[None, :]] = -np.inf
                s, c = np.concatenate([top_s, s], 1), np.concatenate([top_i, np.broadcast_to(own, s.shape)], 1)
                order = np.lexsort((c, -np.round(s, 9)))[:, :k]
                top_s, top_i = np.take_along_axis(s, order, 1), np.take_along_axis(c, order, 1)
            ok = np.isfinite(top_s)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], top_s.shape)[ok], pa.int64()), pa.array(top_i[ok], pa.int64()), pa.array(top_s[ok], pa.float64())], names=["query", "item", "score"])

        got = items.select(F.col(item_id).cast("long"), vector).mapInArrow(best, "query long, item long, score double")
        if blocks > 1:  # each pass is written before the next, so the driver holds one block
            got = materialise(got, "topk")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return items.sparkSession.createDataFrame([], "query long, item long, score double, rank long")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "item")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, one row per dimension: (group, dim, value)."""
    return df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def fuse(df: DataFrame, branches: dict[str, float], out: str = "score", agreement: bool = True) -> DataFrame:
    """Weighted sum of branch scores (null is 0); optionally a bonus where several branches found the row."""
    total = sum(F.coalesce(F.col(b), F.lit(0.0)) * w for b, w in branches.items())
    if agreement:
        n = sum(F.when(F.coalesce(F.col(b), F.lit(0.0)) > 0, 1).otherwise(0) for b in branches)
        total = total + F.when(n >= 3, AGREEMENT[3]).when(n == 2, AGREEMENT[2]).otherwise(0.0)
    return df.withColumn(out, total)


def branch_union(branches: dict[str, DataFrame], query: str, item: str, score: str, per_branch: dict[str, int], total: int, weights: dict[str, float]) -> DataFrame:
    """The best of each branch, merged per candidate and cut again: one column per branch and the fused score."""
    cut = []
    for name, df in branches.items():
        w = Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), item)
        cut.append(df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_branch[name]).select(query, item, F.lit(name).alias("_b"), F.col(score).alias("_s")))
    rows = cut[0]
    for c in cut[1:]:
        rows = rows.unionByName(c)
    merged = rows.groupBy(query, item).agg(*[F.max(F.when(F.col("_b") == b, F.col("_s"))).alias(b) for b in branches])
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), item)
    return fuse(merged, weights).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= total)


def relax_tiers(df: DataFrame, group: str, passes: Sequence[Column], least: int) -> DataFrame:
    """Rows of the strictest tier that keeps ``least`` rows of the group, else of the last; adds ``tier``.

    The tiers are counted in one aggregate and the chosen tier is joined back.
    """
    n = len(passes)
    marked = df.select("*", *[p.alias(f"_t{i}") for i, p in enumerate(passes)])
    counts = marked.groupBy(group).agg(*[F.count_if(F.col(f"_t{i}")).alias(f"_c{i}") for i in range(n)])
    tier = F.lit(n - 1)
    for i in reversed(range(n - 1)):
        tier = F.when(F.col(f"_c{i}") >= least, i).otherwise(tier)
    chosen = counts.select(group, tier.alias("tier"))
    keep = F.lit(False)
    for i in range(n):
        keep = F.when(F.col("tier") == i, F.col(f"_t{i}")).otherwise(keep)
    return marked.join(chosen, group).filter(keep).drop(*[f"_t{i}" for i in range(n)])


@dataclass(frozen=True)
class Policy:
    """Caps and weights of the greedy reranker."""

    per_author: int = 2
    max_age_days: float = 180.0
    author_weight: float = 0.03
    topic_weight: float = 0.05
    freshness_weight: float = 0.04
    half_life_hours: float = 168.0
    locale_bonus: float = 0.02
    top_k: int = 10
    pool: int = 120


def policy_rerank(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Greedy selection under caps and diversity penalties that depend on what was chosen before.

    Rows: query, item, score, author, topic, age_hours, locale_match. Each query's pool is cut
    to ``policy.pool`` before it is grouped, so a group is bounded. Adds ``rank`` and ``adjusted``.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    pool = df.select("query", "item", "score", "author", "topic", "age_hours", "locale_match").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= policy.pool).drop("_rn")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [r for r in pdf.to_dict("records") if not r["age_hours"] > policy.max_age_days * 24]
        authors: dict = {}
        topics: dict = {}
        out = []
        while rows and len(out) < policy.top_k:
            open_ = [r for r in rows if authors.get(r["author"], 0) < policy.per_author]
            if not open_:
                break
            for r in open_:
                fresh = policy.freshness_weight * np.exp(-max(0.0, r["age_hours"]) / policy.half_life_hours)
                seen = policy.author_weight * authors.get(r["author"], 0) + policy.topic_weight * topics.get(r["topic"], 0)
                r["adjusted"] = r["score"] + fresh + policy.locale_bonus * bool(r["locale_match"]) - seen
            best = min(open_, key=lambda r: (-r["adjusted"], -r["score"], r["item"]))
            rows = [r for r in rows if r is not best]
            authors[best["author"]] = authors.get(best["author"], 0) + 1
            topics[best["topic"]] = topics.get(best["topic"], 0) + 1
            out.append((best["query"], best["item"], len(out) + 1, best["adjusted"]))
        return pd.DataFrame(out, columns=["query", "item", "rank", "adjusted"])

    kind = df.schema["query"].dataType.simpleString()
    item = df.schema["item"].dataType.simpleString()
    return pool.groupBy("query").applyInPandas(choose, f"query {kind}, item {item}, rank long, adjusted double")


def mmr_rerank(df: DataFrame, top_n: int, weight: float = 0.5) -> DataFrame:
    """Tags in order of score; each loses ``weight`` times its largest 3-gram similarity to a tag before it.

    Rows: query, tag, score, frequency. The first ``top_n`` are rescored and sorted again.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "tag")
    pool = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n).select("query", "tag", "score", "frequency", "_rn")

    def grams(t: str) -> set[str]:
        return {t[i : i + 3] for i in range(len(t) - 2)}

    def rescore(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, rows = [], []
        for r in pdf.sort_values("_rn").to_dict("records"):
            g = grams(r["tag"])
            close = max((len(g & h) / len(g | h) if g and h else 0.0 for h in seen), default=0.0)
            rows.append((r["query"], r["tag"], round(r["score"] - weight * close, 4) if seen else r["score"], r["frequency"]))
            seen.append(g)
        rows.sort(key=lambda r: (-r[2], -r[3]))
        return pd.DataFrame([(*r, i + 1) for i, r in enumerate(rows)], columns=["query", "tag", "score", "frequency", "rank"])

    return pool.groupBy("query").applyInPandas(rescore, f"query {df.schema['query'].dataType.simpleString()}, tag string, score double, frequency long, rank long")


def negative_samples(df: DataFrame, query: str, item: str, score: str, author: str, topic: str, shares: tuple[float, float, float] = (0.5, 0.3, 0.2), total: int = 10, per_author: int = 2, per_topic: int = 4, seed: int = 7) -> DataFrame:
    """Negatives from the hard, middle and easy third of each query's candidates, in a seeded hash order.

    The order is a hash, so samples repeat; caps per author and topic are rank filters within the query.
    """
    w = Window.partitionBy(query)
    third = F.least(F.floor((F.row_number().over(w.orderBy(F.desc(score), item)) - 1) * 3 / F.count("*").over(w)), F.lit(2))
    rows = df.withColumn("band", third.cast("int")).withColumn("_h", F.sha2(F.concat_ws("|", F.col(query).cast("string"), F.col(item).cast("string"), F.lit(str(seed))), 256))
    rows = rows.withColumn("_a", F.row_number().over(Window.partitionBy(query, author).orderBy("_h"))).filter(F.col("_a") <= per_author)
    rows = rows.withColumn("_t", F.row_number().over(Window.partitionBy(query, topic).orderBy("_h"))).filter(F.col("_t") <= per_topic)
    rows = rows.withColumn("_b", F.row_number().over(Window.partitionBy(query, "band").orderBy("_h")))
    quota = [max(1, round(total * s)) for s in shares]
    wanted = F.when(F.col("band") == 0, quota[0]).when(F.col("band") == 1, quota[1]).otherwise(quota[2])
    # rows within a band's share come first, the others fill up
    order = Window.partitionBy(query).orderBy((F.col("_b") > wanted).cast("int"), "band", "_h")
    return rows.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= total).drop("_h", "_a", "_t", "_b")


def search_knowledge(articles: DataFrame, queries: DataFrame, top: int, title_bonus: float = 0.5) -> DataFrame:
    """Articles (id, title, terms) for queries (query, terms): shared words, a bonus for words of the title."""
    a = articles.select("id", "title", F.explode(F.array_distinct("terms")).alias("t"))
    q = queries.select("query", F.explode(F.array_distinct("terms")).alias("t"))
    s = a.join(q, "t").groupBy("query", "id").agg((F.count("*") + title_bonus * F.count_if(F.lower("title").contains(F.col("t")))).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


#: Weight of the avoided centroid, the largest blend and the least query signal.
AVOIDED, MAX_BLEND, MIN_QUERY_SIGNAL = 0.7, 0.16, 0.20


def creator_scores(rows: DataFrame, branches: dict[str, float], liked: dict[str, Column], avoided: dict[str, Column]) -> DataFrame:
    """Adds ``personal``: nearness to a creator's liked minus 0.7 times the avoided centroid, scaled to 0..1 over all rows, the weighted mean of the branches.

    ``branches``: vector column -> weight; ``liked`` and ``avoided``: centroid column of each, null
    where there is none. A branch without either does not count; without any the score is null.
    """
    from skein.functions.scalars import dot, norm

    unit = lambda c: F.coalesce(dot(F.col("_v"), c) / F.nullif(norm(c), F.lit(0.0)), F.lit(0.0))
    out = rows
    for b in branches:
        known = liked[b].isNotNull() | avoided[b].isNotNull()
        out = out.withColumn("_v", F.col(b)).withColumn(f"_raw_{b}", F.when(known, unit(liked[b]) - AVOIDED * unit(avoided[b]))).drop("_v")
    spans = out.agg(*[f(f"_raw_{b}").alias(f"_{n}_{b}") for b in branches for n, f in (("low", F.min), ("high", F.max))])
    out = out.crossJoin(F.broadcast(spans))
    scaled = {b: F.when(F.col(f"_high_{b}") > F.col(f"_low_{b}"), (F.col(f"_raw_{b}") - F.col(f"_low_{b}")) / (F.col(f"_high_{b}") - F.col(f"_low_{b}"))).when(F.col(f"_raw_{b}").isNotNull(), 0.0) for b in branches}
    total = sum((F.coalesce(scaled[b], F.lit(0.0)) * w for b, w in branches.items()), F.lit(0.0))
    weight = sum((F.when(F.col(f"_raw_{b}").isNotNull(), w).otherwise(0.0) for b, w in branches.items()), F.lit(0.0))
    return out.withColumn("personal", F.when(weight > 0, total / weight)).drop(*[f"_{n}_{b}" for b in branches for n in ("raw", "low", "high")])


def creator_shift(personal: Column, dense: Column, lexical: Column, confidence: Column) -> Column:
    """How far a retrieval score moves towards the personal one: in proportion to the confidence and the query's own signal."""
    signal = 0.65 * dense + 0.35 * lexical
    guard = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (signal - MIN_QUERY_SIGNAL) / (1 - MIN_QUERY_SIGNAL)))
    return F.when((confidence > 0.01) & personal.isNotNull(), MAX_BLEND * confidence * guard * (personal - 0.5) * 2.0).otherwise(0.0)


def frame_relevance(frames: DataFrame, group: str, item: str, vector: str, description: str) -> DataFrame:
    """(group, item, relevance): 0.6 times the inner product with the description, 0.4 times the distance from the group's mean, scaled to 0..1.

    ``description`` is a vector column, null where there is none. The mean is one row per group
    and dimension; distances and scales are aggregates of the group.
    """
    from skein.functions.scalars import dot, safe_div

    means = centroids(frames, group, vector).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("_mean"))
    diff = F.zip_with(F.col(vector), F.col("_mean"), lambda a, b: a.cast("double") - b)
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(dot(vector, description), F.lit(0.0))))
    r = frames.join(means, group).select(group, item, near.alias("_near"), F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)).alias("_far"))
    r = r.join(r.groupBy(group).agg(F.max("_far").alias("_most")), group).withColumn("_s", 0.6 * F.col("_near") + 0.4 * safe_div("_far", "_most"))
    span = r.groupBy(group).agg(F.min("_s").alias("_low"), F.max("_s").alias("_high"))
    scaled = F.when(F.col("_high") > F.col("_low"), (F.col("_s") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.col("_s"))
    return r.join(span, group).select(group, item, scaled.alias("relevance"))


def concept_match(frames: DataFrame, group: str, vector: str, concepts: DataFrame, top: int = 5, least: float = 0.15) -> DataFrame:
    """(group, concept, similarity, rank): the concepts (concept, vector) nearest to a group's mean vector, above ``least``.

    The vocabulary of concepts is a fixed list, so its table is broadcast.
    """
    from skein.functions.scalars import cosine

    means = centroids(frames, group, vector).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("_mean"))
    s = means.crossJoin(F.broadcast(concepts.select("concept", F.col("vector").alias("_v")))).withColumn("similarity", cosine("_mean", "_v"))
    w = Window.partitionBy(group).orderBy(F.desc(F.round("similarity", 9)), "concept")
    return s.select(group, "concept", "similarity", F.row_number().over(w).cast("long").alias("rank")).filter((F.col("rank") <= top) & (F.col("similarity") > least))


def scope(rows: DataFrame, topic: str | None = None, language: str | None = None, exclude: DataFrame | None = None, key: str = "item", fields: Sequence[str] = (), tags: str | None = None) -> DataFrame:
    """Rows of a request's scope: a constraint that is not given passes all; a topic matches one of several fields or a tag."""
    if language is not None:
        rows = rows.filter(F.lower("language") == language.lower())
    if topic is not None:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(f), F.lit(topic.lower())), F.lit(False))
        if tags is not None:
            hit = hit | F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(topic.lower()))), F.lit(False))
        rows = rows.filter(hit)
    return rows if exclude is None else rows.join(exclude.select(key), key, "left_anti")


def contexts(hits: DataFrame, texts: DataFrame, query: str, item: str, rank: str) -> DataFrame:
    """(query, items, context): the texts of a query's hits in the order of their rank, joined by blank lines."""
    joined = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("i"), F.col("text").alias("t"))))
    g = hits.join(texts.select(item, "text"), item).groupBy(query).agg(joined.alias("_h"))
    return g.select(query, F.transform("_h", lambda x: x["i"]).alias("items"), F.array_join(F.transform("_h", lambda x: F.coalesce(x["t"], F.lit(""))), "\n\n").alias("context"))
