"""Candidates and queries of a recommendation request: profiles, support, cold start, merging, final order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.scalars import clamp

# The terms of the objectives in order of priority, and the topics with theirs.
OBJECTIVE_TERMS = {
    "conversion": "buy shop product price discount link bio".split(),
    "community": "comment community join reply friends together".split(),
    "engagement": "viral save share follow comment react".split(),
}
TOPICS = {
    "food": "food recipe cook meal kitchen comida receta".split(),
    "fitness": "fitness workout gym exercise health salud".split(),
    "finance": "finance invest money crypto budget stock trading".split(),
    "beauty": "beauty makeup skincare hair cosmetic".split(),
    "fashion": "fashion outfit style lookbook streetwear".split(),
    "tech": "tech ai software app coding gadget".split(),
    "travel": "travel trip vacation city journey viaje".split(),
    "education": "learn lesson tutorial guide tips teach study".split(),
    "entertainment": "funny meme dance music viral trend reaction".split(),
    "lifestyle": "lifestyle daily routine mindset productivity selfcare".split(),
}
CONTENT_TYPES = "tutorial story reaction showcase opinion commentary trend_participation educational behind_the_scenes other".split()
CTAS = "follow comment save share link_click profile_visit dm none".split()
# What each signal adds to a candidate's support, and the levels.
SUPPORT = {"text": 0.28, "hashtags": 0.10, "keywords": 0.06, "topic_key": 0.05, "freshness": 0.05, "comment_intelligence": 0.10, "language": 0.08, "locale": 0.08, "content_type": 0.08}
SUPPORT_BASE = 0.12
LEVELS = {"full": 0.75, "partial": 0.45}
#: Fixed value: candidates that a memory keeps.
MEMORY = 24


def normalise(x: Column) -> Column:
    """Lower case, with only word characters, ``# @ -`` and single spaces."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"(?U)[^\w\s#@-]", " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalise_list(x: Column) -> Column:
    """The normalised values that are not empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), normalise), lambda v: v != ""))


def one_of(x: Column, allowed: Sequence[str], default: str) -> Column:
    """A normalised value with underscores, if it is one of ``allowed``."""
    v = F.replace(normalise(x), F.lit(" "), F.lit("_"))
    return F.when(v.isin(list(allowed)), v).otherwise(default)


def locale(x: Column) -> Column:
    """Lower case with hyphens, 24 characters at most; null where it is blank."""
    return F.nullif(F.substring(F.lower(F.replace(F.trim(x), F.lit("_"), F.lit("-"))), 1, 24), F.lit(""))


def language(lang: Column, place: Column) -> Column:
    """The language, else the part of the locale before its first hyphen."""
    return F.coalesce(F.nullif(F.lower(F.trim(lang)), F.lit("")), F.nullif(F.substring_index(locale(place), "-", 1), F.lit("")))


def guess_objective(text: Column) -> Column:
    """The first objective one of whose terms the normalised text holds, else reach."""
    out = None
    for name, terms in OBJECTIVE_TERMS.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(text, F.lit(t))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("reach")


def topic_key(explicit: Column, tokens: Column, hashtags: Column) -> Column:
    """A given topic, else the first of the lexicon with a term among the tokens, else the first hashtag, else general."""
    found = None
    for name, terms in TOPICS.items():
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return F.coalesce(F.nullif(F.lower(F.trim(explicit)), F.lit("")), found, F.get(hashtags, F.lit(0)), F.lit("general"))


def freshness_prior(posted: Column, as_of: Column) -> Column:
    """Steps by age in days; the numbers are fixed values."""
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros(posted)) / 8.64e10, F.lit(0.0))
    return F.when(posted.isNull(), 0.50).when(age <= 2, 0.85).when(age <= 14, 0.65).when(age <= 45, 0.45).otherwise(0.30)


def _profile(rows: DataFrame) -> DataFrame:
    """Adds the normalised ``tags``, ``keys``, text and tokens of rows with text, hashtags and keywords."""
    tags = F.transform(normalise_list(F.col("hashtags")), lambda t: F.ltrim(t, F.lit("#")))
    r = rows.withColumn("tags", F.array_distinct(F.filter(tags, lambda t: t != ""))).withColumn("keys", normalise_list(F.col("keywords"))).withColumn("clean", normalise(F.col("text")))
    tokens = F.filter(F.split("clean", " "), lambda w: w != "")
    return r.withColumn("tokens", F.array_distinct(F.concat(tokens, F.col("keys")))).withColumn("lexical_tokens", F.array_distinct(F.concat(tokens, F.col("keys"), F.col("tags"))))


def query_profiles(queries: DataFrame) -> DataFrame:
    """query_id with topic, content type, call to action, language, locale and tokens of a request.

    Needs query_id, text, hashtags, keywords, topic_key, content_type, primary_cta, language, locale.
    """
    q = _profile(queries)
    return q.select(
        "query_id", F.col("clean").alias("query_text"), "tokens", "lexical_tokens", "tags", "keys", topic_key(F.col("topic_key"), F.array_union("tokens", "tags"), F.col("tags")).alias("topic_key"),
        one_of(F.col("content_type"), CONTENT_TYPES, "other").alias("content_type"), one_of(F.col("primary_cta"), CTAS, "none").alias("primary_cta"), language(F.col("language"), F.col("locale")).alias("language"), locale(F.col("locale")).alias("locale"),
    )


def prepare(rows: DataFrame, as_of: str) -> DataFrame:
    """Candidates with profile, objective, support level and flags, and the cold-start fallback.

    Needs candidate_id, author_id, text, hashtags, keywords, topic_key, content_type, language, locale,
    posted_at, views, likes, comments, shares, has_comments and has_trajectory. Rows without an id go.
    Candidates without an author or any content have low support, whatever else they have.
    """
    at = F.lit(as_of).cast("timestamp")
    r = _profile(rows.filter(F.trim(F.coalesce(F.col("candidate_id").cast("string"), F.lit(""))) != ""))
    author = F.lower(F.trim(F.coalesce("author_id", F.lit(""))))
    r = r.withColumn("topic", topic_key(F.col("topic_key"), F.array_union("tokens", "tags"), F.col("tags"))).withColumn("kind", one_of(F.col("content_type"), CONTENT_TYPES, "other"))
    r = r.withColumn("lang", language(F.col("language"), F.col("locale"))).withColumn("place", locale(F.col("locale"))).withColumn("author", author)
    has = {
        "text": F.col("clean") != "", "hashtags": F.size("tags") > 0, "keywords": F.size("keys") > 0, "topic_key": F.col("topic") != "general", "freshness": F.col("posted_at").isNotNull(),
        "comment_intelligence": F.coalesce("has_comments", F.lit(False)), "language": F.col("lang").isNotNull(), "locale": F.col("place").isNotNull(), "content_type": F.col("kind") != "other",
    }
    hard = {"missing_author": F.col("author") == "", "missing_content_signal": ~(has["text"] | has["hashtags"] | has["keywords"])}
    fails = hard["missing_author"] | hard["missing_content_signal"]
    score = F.when(fails, 0.0).otherwise(F.round(clamp(sum((F.when(has[k], w).otherwise(0.0) for k, w in SUPPORT.items()), F.lit(SUPPORT_BASE)), 0.0, 1.0), 4))
    seen = F.greatest(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("views", "likes", "comments", "shares")]) > 0
    cold = ~seen & ~F.coalesce("has_trajectory", F.lit(False))
    flags = [F.when(c, F.lit(k)) for k, c in hard.items()] + [F.when(~fails & ~has[k], F.lit(f"missing_{k}")) for k in SUPPORT] + [F.when(cold, F.lit("cold_start_no_engagement_history"))]
    semantic = clamp(F.when(has["text"], 0.35).otherwise(0.0) + F.least(F.size("tags"), F.lit(5)) * 0.05 + F.least(F.size("keys"), F.lit(5)) * 0.04, 0.0, 1.0)
    prior = F.when(F.col("topic") != "general", 0.65).otherwise(0.35)
    fallback = clamp(semantic * 0.45 + prior * 0.25 + freshness_prior(F.col("posted_at"), at) * 0.20 + F.when(cold, 0.18).otherwise(0.0), 0.0, 1.0)
    words = normalise(F.concat_ws(" ", "clean", F.array_join("tags", " "), F.array_join("keys", " ")))
    return r.select(
        "candidate_id", F.when(F.col("author") == "", "unknown").otherwise(F.col("author")).alias("author_id"), F.col("topic").alias("topic_key"), "tokens", "lexical_tokens", "tags", "keys", F.col("kind").alias("content_type"),
        guess_objective(words).alias("objective_guess"), F.col("lang").alias("language"), F.col("place").alias("locale"), F.coalesce("posted_at", at).alias("posted_at"), score.alias("support_score"),
        F.when(score >= LEVELS["full"], "full").when(score >= LEVELS["partial"], "partial").otherwise("low").alias("support_level"), F.array_compact(F.array(*flags)).alias("support_flags"),
        cold.alias("is_cold_start"), F.round(semantic, 6).alias("semantic_signal"), F.round(fallback, 6).alias("fallback_rank_signal"), F.round(clamp(1.0 - fallback, 0.15, 0.95), 6).alias("uncertainty"),
    )


def merge_payloads(retrieved: DataFrame, request: DataFrame, key: str) -> DataFrame:
    """Retrieved candidates whose values a request's own replace, where these are not null, blank or empty."""

    def given(name: str, kind: T.DataType) -> Column:
        own = F.col(f"r.{name}")
        if isinstance(kind, T.StringType):
            return F.when(F.trim(own) != "", own)
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.when(F.size(own) > 0, own)
        return own

    both = [c for c in retrieved.columns if c in request.columns and c != key]
    pick = lambda c: F.map_concat(F.map_filter(f"t.{c}", lambda k, v: ~F.coalesce(F.map_contains_key(f"r.{c}", k), F.lit(False))), F.coalesce(f"r.{c}", F.create_map().cast(retrieved.schema[c].dataType))) if isinstance(retrieved.schema[c].dataType, T.MapType) else F.coalesce(given(c, retrieved.schema[c].dataType), F.col(f"t.{c}"))
    j = retrieved.alias("t").join(request.alias("r"), F.col(f"t.{key}") == F.col(f"r.{key}"), "left")
    return j.select(*[pick(c).alias(c) if c in both else F.col(f"t.{c}") for c in retrieved.columns])


def final_order(rows: DataFrame, query: str, portfolio: str, score: str, fused: str, item: str, supported: Column) -> DataFrame:
    """Adds ``position``: by portfolio utility where it is supported, else by score; then by score, fused score and item."""
    from pyspark.sql import Window

    first = F.when(supported, F.col(portfolio)).otherwise(F.col(score))
    w = Window.partitionBy(query).orderBy(first.desc(), F.col(score).desc(), F.col(fused).desc(), item)
    return rows.withColumn("position", F.row_number().over(w).cast("long"))


def merge_memory(primary: Column, fallback: Column, most: int = MEMORY) -> Column:
    """Candidates of the first list, then of the second, each once, at most ``most``."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(primary, none), F.coalesce(fallback, none))), 1, most)


# How much each signal counts for the reward of an action.
REWARDS = {
    "reach": {"views": 0.65, "er": 0.25, "spike": 0.10},
    "engagement": {"views": 0.40, "er": 0.45, "balanced": 0.15},
    "conversion": {"views": 0.25, "er": 0.55, "durable": 0.20},
    "retention": {"views": 0.35, "er": 0.55, "balanced": 0.10},
}


def reward(action: str, views: Column, rate: Column, regimes: dict[str, Column]) -> Column:
    """Reward of an action in 0..1 from views, engagement rate and the regime probabilities."""
    signal = {"views": F.least(F.log1p(views) / F.log1p(F.lit(1e7)), F.lit(1.0)), "er": F.least(rate / 0.10, F.lit(1.0)), **regimes}
    return clamp(sum((F.coalesce(signal[k], F.lit(0.0)) * w for k, w in REWARDS[action].items()), F.lit(0.0)), 0.0, 1.0)


def best_action(views: Column, rate: Column, regimes: dict[str, Column]) -> Column:
    """The action with the largest reward, ties to the first."""
    scored = {a: reward(a, views, rate, regimes) for a in REWARDS}
    top = F.greatest(*scored.values())
    out = F.lit(None).cast("string")
    for a in reversed(list(scored)):
        out = F.when(scored[a] == top, a).otherwise(out)
    return out
