"""Training datamart: point-in-time rows, trajectory labels and features, train-only z-scores, pairs and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.scalars import argmax3, follower_bucket, regime_logits, relevance_label, safe_div, softmax3, zscore
from skein.operators.asof import asof_join
from skein.operators.similarity import nearest_earlier
from skein.operators.windows import chronological_split, leave_one_out_mean
from skein.session import materialise

OBJECTIVES = ("conversion", "engagement", "reach")
#: What a build makes.
PARTS = ("rows", "pairs", "stats", "availability")
COMPONENTS = ("early_velocity", "core_velocity", "late_lift", "stability")
#: Shares of early velocity, stability and late lift in the composite target.
COMPOSITE = {"early_velocity": 0.45, "stability": 0.20, "late_lift": 0.35}
TRAJECTORY = ("early_velocity", "core_velocity", "late_lift", "stability", "late_velocity", "acceleration_proxy", "curvature_proxy", "durability_ratio", "peak_lag_hours", "available_ratio", "missing_component_count", "regime_confidence")
COMMENT = ("alignment_score", "value_prop_coverage", "on_topic_ratio", "artifact_drift_ratio", "alignment_shift_early_late", "alignment_confidence")
#: Substrings of the content types, in order.
CONTENT = [("tutorial", ["tutorial", "how to", "step"]), ("story", ["story", "pov"]), ("review", ["review", "unboxing"])]
LATE = "late_out_of_watermark"


@dataclass(frozen=True)
class Config:
    """Track, history, label horizon, trajectory windows, split shares and pair settings."""

    track: str = "pre_publication"
    min_history_hours: int = 24
    label_hours: int = 72
    windows: tuple[int, int, int] = (6, 24, 96)
    train: float = 0.70
    validation: float = 0.15
    min_author_rows: int = 2
    candidates: int = 8
    target_source: str = "scalar_v1"
    run_at: str = "2099-01-01"
    weights: dict = field(default_factory=lambda: {o: dict(COMPOSITE) for o in OBJECTIVES})

    def __post_init__(self):
        if self.track not in ("pre_publication", "post_publication"):
            raise ValueError(f"unknown track {self.track}")
        if self.target_source not in ("scalar_v1", "trajectory_v2_composite"):
            raise ValueError(f"unknown target source {self.target_source}")
        if self.min_history_hours < 0 or self.label_hours <= 0:
            raise ValueError("hours must be positive")
        if not 0 < self.train < 1 or not 0 < self.validation < 1 or self.train + self.validation >= 1:
            raise ValueError("split shares must leave room for a test split")
        if list(self.windows) != sorted(set(self.windows)) or min(self.windows) <= 0:
            raise ValueError("windows must rise from above 0")

    @property
    def marks(self) -> dict[str, int]:
        """The four boundaries: name -> hours after ``as_of``."""
        return dict(zip(("t0", *[f"t{h}" for h in (6, 24, 96)]), (0, *self.windows), strict=True))


def _hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def picked_snapshots(videos: DataFrame, snapshots: DataFrame, config: Config) -> DataFrame:
    """video_id, as_of, the snapshots ``pre`` and ``future``, and at each boundary a snapshot and the reason without one.

    One equi join and one aggregate, which combines on the map side: no video's history is
    sorted or collected. Late snapshots never count; others count once they were ingested.
    At a boundary stands the latest snapshot up to it that was known at the run.
    """
    kind = F.coalesce("lateness", F.lit("on_time")) if "lateness" in snapshots.columns else F.lit("on_time")
    known = F.coalesce("ingested_at", "event_time") if "ingested_at" in snapshots.columns else F.col("event_time")
    metrics = [F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long").alias(c) for c in ("views", "likes", "comments_count", "shares")]
    s = snapshots.select(F.col("video_id").alias("_v"), F.col("event_time").alias("_e"), known.alias("_i"), (kind == LATE).alias("_late"), F.struct("event_time", *metrics).alias("_s"), F.struct(F.col("event_time"), known.alias("i"), "video_snapshot_id").alias("_o"))
    j = videos.select("video_id", (F.col("posted_at") + _hours(config.min_history_hours)).alias("as_of")).join(s, F.col("video_id") == F.col("_v"), "left")
    run = F.lit(config.run_at).cast("timestamp")
    latest = lambda cond: F.max_by(F.when(cond, F.col("_s")), F.when(cond, F.col("_o")))
    ok = ~F.col("_late")
    future = ok & (F.col("_e") >= F.col("as_of") + _hours(config.label_hours)) & (F.col("_i") <= run)
    aggs = [latest(ok & (F.col("_e") <= F.col("as_of")) & (F.col("_i") <= F.col("as_of"))).alias("pre"), F.min_by(F.when(future, F.col("_s")), F.when(future, F.col("_o"))).alias("future")]
    for name, h in config.marks.items():
        upto = F.col("_e") <= F.col("as_of") + _hours(h)
        aggs += [F.count_if(upto).alias(f"_any_{name}"), F.count_if(upto & ok).alias(f"_ok_{name}"), latest(upto & ok & (F.col("_i") <= run)).alias(name)]
    got = j.groupBy("video_id", "as_of").agg(*aggs)
    for name in config.marks:
        missing = "missing_anchor_snapshot" if name == "t0" else f"missing_{name}_snapshot"
        reason = F.when(F.col(name).isNotNull(), None).when(F.col(f"_any_{name}") == 0, missing).when(F.col(f"_ok_{name}") == 0, LATE).otherwise("ingested_after_cutoff")
        got = got.withColumn(f"reason_{name}", reason).drop(f"_any_{name}", f"_ok_{name}")
    return got


def _series(objective: str, snapshot: str) -> Column:
    views, likes, comments, shares = (F.col(f"{snapshot}.{c}") for c in ("views", "likes", "comments_count", "shares"))
    at_least = F.greatest(views, F.lit(1))
    return F.round({"reach": F.log1p(views), "engagement": (likes + comments + shares) / at_least, "conversion": shares * 1000 / at_least}[objective], 6)


def trajectory_labels(picked: DataFrame, config: Config) -> DataFrame:
    """Adds for each objective its series, components, whether it is available, and the reasons where it is not."""
    h6, h24, h96 = config.windows
    out = picked.select("*", *[_series(o, t).alias(f"{o}_{t}") for o in OBJECTIVES for t in config.marks])
    for o in OBJECTIVES:
        t0, t6, t24, t96 = (F.col(f"{o}_{t}") for t in config.marks)
        early, core, last = F.round((t6 - t0) / h6, 6), F.round((t24 - t6) / (h24 - h6), 6), F.round((t96 - t24) / (h96 - h24), 6)
        m = (early + core + last) / 3
        spread = F.sqrt((F.pow(early - m, F.lit(2)) + F.pow(core - m, F.lit(2)) + F.pow(last - m, F.lit(2))) / 2)
        out = out.select("*", early.alias(f"{o}_early_velocity"), core.alias(f"{o}_core_velocity"), F.round(t96 - t24, 6).alias(f"{o}_late_lift"), F.round(-spread, 6).alias(f"{o}_stability"))
        there = F.col(f"{o}_stability").isNotNull() & F.col(f"{o}_late_lift").isNotNull() & F.col(f"{o}_early_velocity").isNotNull()
        why = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(f"reason_{t}") for t in config.marks]))))
        out = out.withColumn(f"{o}_available", there).withColumn(f"{o}_reasons", F.when(there, F.array().cast("array<string>")).otherwise(why))
    return out


def trajectory_features(rows: DataFrame, config: Config) -> DataFrame:
    """Adds the derived features ``tr_*`` of the labels, means over the objectives; a component that is missing counts as 0."""
    h6, h24, h96 = config.windows
    part = lambda o, c: F.coalesce(F.col(f"{o}_{c}"), F.lit(0.0))
    mean = {c: sum((part(o, c) for o in OBJECTIVES), F.lit(0.0)) / 3.0 for c in COMPONENTS}
    out = rows.select("*", *[v.alias(f"_{c}") for c, v in mean.items()])
    reach = {h: F.coalesce(F.col(f"reach_{t}"), F.lit(0.0)) for t, h in config.marks.items()}
    top = F.greatest(*reach.values())
    peak = F.lit(float(h96))
    for h in reversed(list(reach)[:-1]):
        peak = F.when(reach[h] == top, float(h)).otherwise(peak)
    early, core, late, stability = (F.col(f"_{c}") for c in COMPONENTS)
    late_velocity = late / max(1, h96 - h24)
    ratio = F.greatest(late, F.lit(0.0)) / F.greatest(F.abs(reach[h24] - reach[0]), F.lit(1e-6))
    flags = sum((F.col(f"{o}_{c}").isNotNull().cast("int") for o in OBJECTIVES for c in COMPONENTS), F.lit(0))
    out = out.select("*", ratio.alias("_ratio"))
    probs = [F.round(p, 6) for p in softmax3(*regime_logits(early, late, F.col("_ratio"), stability))]
    names = ("spike", "balanced", "durable")
    out = out.select("*", *[p.alias(f"regime_{n}") for n, p in zip(names, probs, strict=True)])
    p = [F.col(f"regime_{n}") for n in names]
    second = p[0] + p[1] + p[2] - F.greatest(*p) - F.least(*p)
    made = {
        "early_velocity": early, "core_velocity": core, "late_lift": late, "stability": stability, "late_velocity": late_velocity, "acceleration_proxy": core - early, "curvature_proxy": late_velocity - core,
        "durability_ratio": F.col("_ratio"), "peak_lag_hours": peak, "available_ratio": flags / 12.0, "missing_component_count": (F.lit(12) - flags).cast("double"), "regime_confidence": F.greatest(*p) - second,
    }
    out = out.select("*", *[F.round(v, 6).alias(f"tr_{k}") for k, v in made.items()], argmax3(*p, names=names).alias("regime"))
    return out.drop(*[f"_{c}" for c in COMPONENTS], "_ratio")


def point_in_time_rows(bundle: dict[str, DataFrame], config: Config) -> DataFrame:
    """One row per video with ``exclusion_reason``, null where it may be used; raw targets, features and trajectory labels."""
    videos, run = bundle["videos"], F.lit(config.run_at).cast("timestamp")
    v = videos.select("video_id", "author_id", "caption", "hashtags", *[F.col(c) if c in videos.columns else F.lit(None).cast(t).alias(c) for c, t in (("keywords", "array<string>"), ("search_query", "string"), ("language", "string"), ("duration_seconds", "int"))], "posted_at")
    got = picked_snapshots(videos, bundle["video_snapshots"], config)
    r = v.join(got, "video_id")
    reason = F.when(F.col("as_of") >= run, "insufficient_history_window").when(F.col("as_of") + _hours(config.label_hours) > run, "label_horizon_not_available").when(F.col("future").isNull(), "missing_future_snapshot")
    views = F.col("future.views")
    rate = F.col("future.likes") + F.col("future.comments_count") + F.col("future.shares")
    per_1k = F.col("future.shares") * 1000 / F.greatest(views, F.lit(1))
    none = F.array().cast("array<string>")
    tags, keywords = F.coalesce("hashtags", none), F.coalesce("keywords", none)
    bare = F.filter(F.transform(tags, lambda t: F.lower(F.trim(F.replace(t, F.lit("#"))))), lambda t: t != "")
    topic = T.infer_topic("search_query", "hashtags", "caption")
    tokens = F.array_distinct(F.concat(T.words(F.coalesce("caption", F.lit(""))), bare, T.words(F.array_join(keywords, " ")), T.words(F.coalesce("search_query", F.lit(""))), T.words(topic)))
    sizes = bundle["authors"].groupBy("author_id").agg(F.max("followers").alias("followers"))
    r = r.join(sizes, "author_id", "left")
    r = r.select(
        "*", F.concat_ws("::", "video_id", F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss")).alias("row_id"), reason.alias("exclusion_reason"), topic.alias("topic_key"), T.content_type(F.concat_ws(" ", "caption", F.array_join(tags, " ")), CONTENT).alias("content_type"), follower_bucket("followers").alias("author_size"), tokens.alias("tokens"),
        F.log1p(F.greatest(views - F.coalesce(F.col("pre.views"), F.lit(0)), F.lit(0))).alias("y_reach"), F.log1p(rate / F.greatest(views, F.lit(1))).alias("y_engagement"), F.log1p(per_1k).alias("y_conversion"), F.log1p(views).alias("log_views"),
        F.array_compact(F.array(F.when(F.col("duration_seconds").isNull(), "missing_duration_seconds"), F.when(F.coalesce("language", F.lit("")) == "", "missing_language"), F.when(F.col("pre").isNull(), "missing_pre_snapshot"))).alias("missingness_flags"),
    )
    return trajectory_features(trajectory_labels(r, config), config)


def comments_before(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Adds count, mean length in words and share of questions of the comments that were there at ``as_of``."""
    known = F.coalesce("ingested_at", "created_at") if "ingested_at" in comments.columns else F.col("created_at")
    c = comments.select(F.col("video_id").alias("_v"), F.col("created_at").alias("_t"), known.alias("_i"), F.size(T.words(F.coalesce("text", F.lit("")))).alias("_n"), F.coalesce("text", F.lit("")).contains("?").cast("int").alias("_q"))
    per = rows.select("video_id", "as_of").join(c, (F.col("video_id") == F.col("_v")) & (F.col("_t") <= F.col("as_of")) & (F.col("_i") <= F.col("as_of")))
    per = per.groupBy("video_id").agg(F.count("*").alias("comments_pre"), F.round(F.avg("_n"), 6).alias("comment_length_pre"), F.round(F.avg("_q"), 6).alias("question_ratio_pre"))
    return rows.join(per, "video_id", "left").fillna({"comments_pre": 0, "comment_length_pre": 0.0, "question_ratio_pre": 0.0})


def comment_intelligence(rows: DataFrame, bundle: dict[str, DataFrame], config: Config) -> DataFrame:
    """Adds the ``COMMENT`` features and ``comment_source``: after publication from the video's latest snapshot, before from the prior of its kind, else missing."""
    if config.track == "post_publication" and "comment_features" in bundle:
        f = bundle["comment_features"].select(F.col("video_id").alias("_v"), F.col("as_of_time").alias("_t"), F.lit(0).alias("_tie"), *COMMENT)
        rows = asof_join(rows, f, [("video_id", "_v")], F.col("as_of"), "_t", "_tie", ["_t", *COMMENT])
        found, source, why = F.col("_t").isNotNull(), "video_snapshot", "missing_comment_snapshot_manifest_row"
    elif config.track == "pre_publication" and "comment_priors" in bundle:
        keys = ["topic_key", "content_type", "author_size"]
        p = bundle["comment_priors"].select(*keys, *[F.col(c) if c in bundle["comment_priors"].columns else F.lit(0.0).alias(c) for c in COMMENT], F.lit(True).alias("_t"))
        rows = rows.join(p, keys, "left")
        found, source, why = F.col("_t").isNotNull(), "transfer_prior", "missing_transfer_prior"
    else:
        rows = rows.select("*", F.lit(None).alias("_t"), *[F.lit(None).cast("double").alias(c) for c in COMMENT])
        found, source, why = F.lit(False), "none", "missing_transfer_prior" if config.track == "pre_publication" else "missing_comment_snapshot_manifest_row"
    flags = F.when(found, F.col("missingness_flags")).otherwise(F.array_append("missingness_flags", F.lit(f"comment_intelligence:{why}")))
    rows = rows.withColumn("comment_source", F.when(found, source).otherwise("missing")).withColumn("missingness_flags", flags)
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in COMMENT}).drop("_t")


def train_only_z(rows: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Adds ``<column>_z`` by the mean and sample deviation of the train rows, which are one broadcast row."""
    stats = rows.filter(F.col(split) == "train").agg(*[f for c in columns for f in (F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{c}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"_s_{c}"))])
    j = rows.crossJoin(F.broadcast(stats))
    return j.select(*rows.columns, *[zscore(c, f"_m_{c}", f"_s_{c}").alias(f"{c}_z") for c in columns])


def composites(rows: DataFrame, config: Config) -> DataFrame:
    """Adds each objective's raw ``<objective>_composite``, null where a part is missing."""
    total = lambda o: sum((F.col(f"{o}_{c}") * w for c, w in config.weights[o].items()), F.lit(0.0))
    return rows.select("*", *[total(o).alias(f"{o}_composite") for o in OBJECTIVES])


def pair_rows(rows: DataFrame, config: Config = Config(), salt_rows: int = 10000) -> DataFrame:
    """Query, candidate, similarity, objective, score and label: the most similar earlier candidates that share tokens, for all objectives.

    ``salt_rows``: about how many candidates a task holds at once. With trajectory targets a
    query whose objective is not available has no pairs for it, nor has a candidate.
    """
    trajectory = config.target_source == "trajectory_v2_composite"
    target = lambda o: f"{o}_composite_z" if trajectory else f"y_{o}_z"
    top = nearest_earlier(rows.select(F.col("video_id").alias("id"), F.unix_micros("as_of").alias("at"), "tokens"), config.candidates, salt_rows)
    ask = lambda o: F.col(f"{o}_available") if trajectory else F.lit(True)
    q = rows.select(F.col("video_id").alias("q"), F.col("row_id").alias("query_row_id"), *[ask(o).alias(f"ask_{o}") for o in OBJECTIVES])
    parts = lambda o: F.struct(*[F.round(f"{o}_{c}_z", 6).alias(c) for c in COMPOSITE], F.col(f"{o}_available").alias("available"))
    c = rows.select(F.col("video_id").alias("c"), F.col("row_id").alias("candidate_row_id"), *[F.col(target(o)).alias(f"score_{o}") for o in OBJECTIVES], *[parts(o).alias(f"parts_{o}") for o in OBJECTIVES])
    per = F.explode(F.array(*[F.struct(F.lit(o).alias("objective"), F.col(f"ask_{o}").alias("asked"), F.col(f"score_{o}").alias("objective_score"), F.col(f"parts_{o}").alias("components")) for o in OBJECTIVES]))
    out = top.join(q, "q").join(c, "c").select(F.col("q").alias("query_id"), F.col("c").alias("candidate_id"), "query_row_id", "candidate_row_id", F.round("similarity", 6).alias("similarity"), per.alias("o"))
    out = out.select("query_id", "candidate_id", "query_row_id", "candidate_row_id", "similarity", "o.*").filter("asked and objective_score is not null").drop("asked")
    return out.withColumn("relevance_label", relevance_label("objective_score")).withColumn("objective_score", F.round("objective_score", 6)).withColumn("pair_id", F.concat_ws("::", "query_row_id", "candidate_row_id"))


def build(bundle: dict[str, DataFrame], config: Config = Config(), parts: Sequence[str] = PARTS) -> dict[str, DataFrame]:
    """The asked ``parts`` of the datamart, rows, pairs and statistics, from canonical entities.

    ``bundle``: videos, video_snapshots, authors; optional comments, comment_features and
    comment_priors. Usable rows and finished rows are read several times, so they are written
    first; exclusions alone read the rows once, and nobody pays for pairs but who asks for them.
    """
    if unknown := set(parts) - set(PARTS):
        raise ValueError(f"unknown parts {sorted(unknown)}")
    rows = point_in_time_rows(bundle, config)
    count = lambda r: r.groupBy(F.coalesce("exclusion_reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))
    if set(parts) == {"stats"}:
        return {"stats": count(rows)}
    rows = materialise(rows, "point-in-time")
    usable = rows.filter("exclusion_reason is null")
    if config.track == "post_publication" and "comments" in bundle:
        usable = comments_before(usable, bundle["comments"])
    usable = composites(comment_intelligence(usable, bundle, config), config)
    split = chronological_split(usable, "as_of", "row_id", config.train, config.validation)
    scored = [f"y_{o}" for o in OBJECTIVES] + [f"{o}_{c}" for o in OBJECTIVES for c in (*COMPONENTS, "composite")] + [f"tr_{c}" for c in TRAJECTORY] + list(COMMENT)
    z = train_only_z(split, scored)
    z = leave_one_out_mean(z, "author_id", "log_views", "split", config.min_author_rows).withColumnRenamed("baseline", "author_expected_log_views")
    z = z.withColumn("residual_log_views", F.round(F.col("log_views") - F.col("author_expected_log_views"), 6)).withColumn("track", F.lit(config.track))
    z = materialise(z.drop("pre", "future", *config.marks), "rows")
    made = {"rows": lambda: z, "pairs": lambda: pair_rows(z, config), "stats": lambda: count(rows), "availability": lambda: availability(z)}
    return {k: made[k]() for k in PARTS if k in parts}


def availability(rows: DataFrame) -> DataFrame:
    """(objective, split, rows, available, rate): for how many rows the trajectory target of an objective is there."""
    per = F.explode(F.array(*[F.struct(F.lit(o).alias("objective"), F.col(f"{o}_available").alias("there")) for o in OBJECTIVES]))
    g = rows.select("split", per.alias("o")).groupBy("o.objective", "split").agg(F.count("*").alias("rows"), F.count_if(F.col("o.there")).alias("available"))
    return g.withColumn("rate", F.round(safe_div("available", "rows"), 6))
