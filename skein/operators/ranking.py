"""Candidate scoring: components, objective weights, affinity, blend search and learned rankers."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.scalars import clamp, round6
from skein.functions.text import jaccard
from skein.operators.evaluation import ranking_metrics

COMPONENTS = ("semantic_relevance", "intent_alignment", "performance_quality", "reference_usefulness", "support_confidence", "trajectory_alignment")
# Component weights by objective, in the order of COMPONENTS, and the support thresholds.
WEIGHTS = {
    "default": (0.25, 0.20, 0.18, 0.13, 0.08, 0.16),
    "reach": (0.21, 0.17, 0.25, 0.13, 0.08, 0.16),
    "engagement": (0.23, 0.20, 0.18, 0.12, 0.09, 0.18),
    "conversion": (0.17, 0.30, 0.12, 0.12, 0.12, 0.17),
}
SUPPORT_FULL, SUPPORT_PARTIAL = 0.75, 0.45


def weighted_score(objective: Column) -> Column:
    """Sum of the component columns under the objective's weights; unknown objectives take the default."""
    out = None
    for name, weights in WEIGHTS.items():
        total = sum(F.col(c) * w for c, w in zip(COMPONENTS, weights, strict=True))
        if name == "default":
            fallback = total
        else:
            out = F.when(objective == name, total) if out is None else out.when(objective == name, total)
    return round6(clamp(out.otherwise(fallback), 0.0, 1.0))


def support_level(score: Column) -> Column:
    return F.when(score >= SUPPORT_FULL, "full").when(score >= SUPPORT_PARTIAL, "partial").otherwise("low")


def semantic_relevance(semantic: Column, hashtag: Column) -> Column:
    return round6(clamp(semantic * 0.70 + hashtag * 0.30, 0.0, 1.0))


def locale_fit(q_locale: Column, q_language: Column, c_locale: Column, c_language: Column) -> Column:
    return F.when(q_locale == c_locale, 1.0).when(q_language == c_language, 0.75).when(c_locale.isNull() & c_language.isNull(), 0.50).otherwise(0.20)


def audience_fit(audience: Column, tokens: Column) -> Column:
    return F.when(F.size(F.coalesce(audience, F.array().cast("array<string>"))) == 0, 0.55).otherwise(round6(jaccard(audience, tokens)))


def cta_fit(text: Column, terms: Sequence[str]) -> Column:
    if not terms:
        return F.lit(0.60)
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower(text), F.lit(t.lower()))
    return F.when(hit, 1.0).otherwise(0.25)


def intent_alignment(objective: Column, content: Column, cta: Column, audience: Column, locale: Column) -> Column:
    return round6(clamp(objective * 0.25 + content * 0.30 + cta * 0.20 + audience * 0.15 + locale * 0.10, 0.0, 1.0))


def heuristic(objective: str, f: Callable[[str], Column] = F.col) -> Column:
    """Hand-made score of an objective from metadata features."""
    if objective == "reach":
        return 0.50 * f("hashtag_count") + 0.10 * f("caption_word_count") + 0.30 * f("content_type_general") + 0.10 * f("content_type_review") - 0.02 * F.abs(f("duration_seconds") - 25.0)
    if objective == "engagement":
        return 0.40 * f("caption_has_question") + 0.50 * f("content_type_tutorial") + 0.20 * f("content_type_review") + 0.10 * f("hashtag_count") - 0.05 * F.pow(f("caption_word_count") - 10.0, F.lit(2))
    if objective == "conversion":
        evening = F.when(f("posted_hour") >= 0, F.greatest(F.lit(0.0), 1 - F.abs(f("posted_hour") - 19.0) / 6.0)).otherwise(0.0)
        return 0.60 * f("content_type_review") + 0.45 * f("content_type_tutorial") + 0.20 * f("caption_has_question") + 0.15 * evening - 0.02 * f("caption_word_count")
    return F.lit(0.0)


#: Shares of the four parts of the affinity, the largest shift and the query guard.
AFFINITY = {"topic": 0.42, "hashtags": 0.28, "content_type": 0.20, "author": 0.10}
AFFINITY_SHIFT = 0.08
AFFINITY_GUARD = 0.18


def _total(weights: Column) -> Column:
    return F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, x: s + x)


def _margin(liked: Column, avoided: Column, of_liked: Column, of_avoided: Column) -> Column:
    share = lambda part, total: F.when(total > 0, part / total).otherwise(0.0)
    return clamp(0.5 + (share(liked, of_liked) - share(avoided, of_avoided)) * 0.5, 0.0, 1.0)


def token_affinity(tokens: Column, preferred: Column, avoided: Column) -> Column:
    """How far a candidate's tokens lie in the preferred rather than the avoided weights: 0..1, 0.5 without tokens."""
    own = F.array_distinct(F.filter(tokens, lambda t: F.length(t) > 0))
    hits = lambda m: F.aggregate(F.transform(own, lambda t: F.coalesce(F.element_at(m, t), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(own) > 0, _margin(hits(preferred), hits(avoided), _total(preferred), _total(avoided))).otherwise(0.5)


def value_affinity(value: Column, preferred: Column, avoided: Column) -> Column:
    """The same for a single value."""
    weight = lambda m: F.coalesce(F.element_at(m, value), F.lit(0.0))
    return F.when(F.length(F.coalesce(value, F.lit(""))) > 0, _margin(weight(preferred), weight(avoided), _total(preferred), _total(avoided))).otherwise(0.5)


def affinity(parts: dict[str, Column]) -> Column:
    """The weighted sum of the four parts ``topic``, ``hashtags``, ``content_type`` and ``author``."""
    return clamp(sum((parts[k] * w for k, w in AFFINITY.items()), F.lit(0.0)), 0.0, 1.0)


def affinity_confidence(positive: Column, negative: Column, requests: Column, days: Column, same_objective: Column) -> Column:
    """How far an owner's feedback carries: events, requests, balance and recency. The numbers are fixed values."""
    p, n = F.coalesce(positive, F.lit(0)), F.coalesce(negative, F.lit(0))
    balance = F.when((p > 0) & (n > 0), F.least(p, n) / F.greatest(p, n)).when(p > 0, 0.35).otherwise(0.0)
    recent = clamp(1.0 - F.coalesce(days, F.lit(999.0)) / 180.0, 0.0, 1.0)
    raw = clamp((p + n) / 24.0, 0.0, 1.0) * 0.45 + clamp(F.coalesce(requests, F.lit(0)) / 8.0, 0.0, 1.0) * 0.20 + balance * 0.20 + recent * 0.15
    return clamp(raw, 0.0, 1.0) * F.when(same_objective, 1.0).otherwise(0.85)


def blend_affinity(score: Column, semantic: Column, fit: Column, confidence: Column) -> Column:
    """The score shifted by the affinity, in proportion to the confidence and to how well the candidate meets the query."""
    guard = clamp((semantic - AFFINITY_GUARD) / (1 - AFFINITY_GUARD), 0.0, 1.0)
    return F.when(confidence <= 0.01, score).otherwise(clamp(score + AFFINITY_SHIFT * confidence * guard * (fit - 0.5) * 2.0, 0.0, 1.0))


# The least signal of a shortlist, the pairs for full authority, the largest shift, and the guard of the head.
MIN_SIGNAL, FULL_PAIRS, MAX_SHIFT, HEAD_RANK, HEAD_AUTHORITY = 0.06, 1500.0, 0.12, 3, 0.75


def pairwise_rerank(rows: DataFrame, pairs: DataFrame, trained_pairs: int) -> DataFrame:
    """Shortlists moved by the win rates of a pairwise model, within a budget: adds learned_score, reranked, reason and position.

    ``rows``: query, item, rank (from 1), score, fused; ``pairs``: query, first, second and prob,
    the chance that the first wins. The budget is the shortlist's mean distance from even odds
    times the authority of the training pairs. Shortlists with too little signal stay as they
    are, and so do those whose learned favourite ranks low while the authority is small.
    """
    both = pairs.select("query", F.col("first").alias("item"), F.col("prob").alias("p")).unionByName(pairs.select("query", F.col("second").alias("item"), (1.0 - F.col("prob")).alias("p")))
    size = rows.groupBy("query").agg(F.count("*").alias("_n"))
    wins = both.groupBy("query", "item").agg(F.sum("p").alias("_wins"))
    signal = pairs.groupBy("query").agg((F.avg(F.abs(F.col("prob") - 0.5)) * 2.0).alias("_signal"))
    r = rows.join(size, "query").join(wins, ["query", "item"], "left").withColumn("_rate", F.coalesce("_wins", F.lit(0.0)) / F.greatest(F.col("_n") - 1, F.lit(1)))
    first = r.groupBy("query").agg(F.min_by("rank", F.struct(-F.col("_rate"), "rank")).alias("_top"))
    r = r.join(signal, "query", "left").join(first, "query")
    authority = min(1.0, max(0.0, trained_pairs / FULL_PAIRS))
    base = clamp(F.coalesce("score", F.lit(0.0)), 0.0, 1.0)
    reason = F.when(F.col("_n") == 1, None).when(F.coalesce("_signal", F.lit(0.0)) < MIN_SIGNAL, "shortlist_signal_below_threshold")
    if authority < HEAD_AUTHORITY:
        reason = reason.when(F.col("_top") > HEAD_RANK, "baseline_head_guard")
    margin = (F.col("_rate") - 0.5) * 2.0
    moved = clamp(base + MAX_SHIFT * F.col("_signal") * authority * margin * F.abs(margin), 0.0, 1.0)
    apply = (F.col("_n") > 1) & F.col("reason").isNull()
    out = r.withColumn("reason", reason).withColumn("learned_score", F.round(F.when(apply, F.col("_rate")).otherwise(base), 6)).withColumn("reranked", F.round(F.when(apply, moved).otherwise(base), 6))
    w = Window.partitionBy("query").orderBy(F.desc("reranked"), F.desc("score"), F.desc("fused"), "rank")
    return out.withColumn("position", F.row_number().over(w).cast("long")).select(*rows.columns, "learned_score", "reranked", "reason", "position")


def blend_search(scores: DataFrame, query: str, item: str, relevance: str, branches: Sequence[str], step: float = 0.25, k: int = 10) -> DataFrame:
    """NDCG of every weight mix of a grid over the branches, best first.

    The branch scores are computed once; the grid is a small fixed table, and each mix is
    ranked within (mix, query).
    """
    ticks = [i * step for i in range(int(round(1 / step)) + 1)]
    mixes = [m for m in itertools.product(ticks, repeat=len(branches)) if math.isclose(sum(m), 1.0)]
    spark = scores.sparkSession
    grid = spark.createDataFrame([(i, *map(float, m)) for i, m in enumerate(mixes)], "mix int, " + ", ".join(f"w_{b} double" for b in branches))
    total = sum(F.coalesce(F.col(b), F.lit(0.0)) * F.col(f"w_{b}") for b in branches)
    fused = scores.crossJoin(F.broadcast(grid)).withColumn("_s", F.round(total, 9)).withColumn("_g", F.struct("mix", query))
    metrics = ranking_metrics(fused, "_g", "_s", relevance, item, k)
    means = metrics.groupBy(F.col("_g.mix").alias("mix")).agg(F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("mrr"), 6).alias("mrr"))
    return means.join(F.broadcast(grid), "mix").orderBy(F.desc("ndcg"), "mix")


def fit_pairwise_weights(pairs: DataFrame, features: Sequence[str], rounds: int = 60, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights of a linear ranker from preference pairs (winner and loser features), by gradient descent.

    Each round is one aggregate over the pairs; only a vector of gradient sums reaches the driver.
    """
    diff = pairs.select(*[(F.col(f"win_{f}") - F.col(f"lose_{f}")).alias(f) for f in features]).persist()
    n = max(1, diff.count())
    w = np.zeros(len(features))
    for _ in range(rounds):
        margin = sum((F.col(f) * float(x) for f, x in zip(features, w, strict=True)), F.lit(0.0))
        pull = 1 / (1 + F.exp(margin))
        g = diff.agg(*[F.sum(F.col(f) * pull).alias(f) for f in features]).first()
        w = w + rate * (np.array([g[f] or 0.0 for f in features]) / n - l2 * w)
    diff.unpersist()
    return w


def search_weights(evaluate: Callable[[np.ndarray], float], dims: int, start: int = 8, rounds: int = 16, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights on the simplex with the best value found by a Gaussian-process search with expected improvement.

    ``evaluate`` runs one plan; everything else is a few small matrices on the driver.
    """
    rng = np.random.default_rng(seed)
    x = rng.dirichlet(np.ones(dims), start)
    y = np.array([evaluate(v) for v in x])
    for _ in range(rounds):
        kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / 0.18)
        inv = np.linalg.inv(kernel(x, x) + 1e-4 * np.eye(len(x)))
        c = rng.dirichlet(np.ones(dims), 256)
        kc = kernel(c, x)
        mean = y.mean() + kc @ inv @ (y - y.mean())
        sd = np.sqrt(np.maximum(1e-12, 1 - np.einsum("ij,jk,ik->i", kc, inv, kc)))
        z = (mean - y.max()) / sd
        gain = (mean - y.max()) * 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2))) + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        nxt = c[gain.argmax()]
        x, y = np.vstack([x, nxt]), np.append(y, evaluate(nxt))
    return x[y.argmax()], float(y.max())


def engagement_model(train: DataFrame, features: Sequence[str], target: str, trees: int = 50, depth: int = 2):
    """A gradient-boosted regressor fitted on the executors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep"), GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, maxDepth=depth, seed=7)]).fit(train)


def cold_start_trace(rows: Column, least: int = 20) -> Column:
    """Whether there is enough history to trust a score, and which fallback applies."""
    return F.when(rows == 0, "global_prior").when(rows < least, "blended_prior").otherwise("own_history")


def explain(objective: Column, top: int = 3) -> Column:
    """The components that weigh most in a score: (component, contribution), largest first."""
    weight = lambda i: F.element_at(F.create_map(*[F.lit(x) for o, w in WEIGHTS.items() for x in (o, w[i])]), F.coalesce(objective, F.lit("default")))
    parts = F.array(*[F.struct((-F.round(F.col(c) * weight(i), 6)).alias("c"), F.lit(c).alias("component")) for i, c in enumerate(COMPONENTS)])
    return F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: F.struct(x["component"].alias("component"), (-x["c"]).alias("contribution")))


def percentile_floor(df: DataFrame, group: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """The value at place ``floor((n - 1) * q)`` of each group's sorted values, from counts per value."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    run = per.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*group).orderBy(value))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    return run.filter(F.col("_upto") > F.floor((F.col("_n") - 1) * q)).groupBy(*group).agg(F.min(value).alias(out))
