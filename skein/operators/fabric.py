"""Rule-based features of posts: text, structure, audio and visual hints, with missing reasons and calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.scalars import clamp
from skein.functions.text import words

# Call-to-action terms, segment windows per content type, and calibration (slope, bias).
CTA_TERMS = "follow comment save share subscribe join shop link bio sigue guarda comenta".split()
WINDOWS = {"tutorial": (0.16, 0.78), "story": (0.14, 0.83), "reaction": (0.12, 0.74), "showcase": (0.15, 0.80), "opinion": (0.18, 0.82)}
CALIBRATION = {"text": (0.94, 0.03), "structure": (0.92, 0.04), "audio": (0.90, 0.05), "visual": (0.90, 0.05)}


def source_age_hours() -> Column:
    """Hours from the last update of the source to ``as_of_time``, 0 at least; null where it is unknown."""
    age = (F.unix_micros(F.col("as_of_time").cast("timestamp")) - F.unix_micros(F.col("source_updated_at").cast("timestamp"))) / 3.6e9
    return F.when(F.col("source_updated_at").isNotNull(), F.round(F.greatest(age, F.lit(0.0)), 4))


def _missing(**reasons: tuple[Column, str]) -> Column:
    """Map of feature -> (reason, source_age_hours) for the features whose condition holds."""
    entries = F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), F.struct(F.lit(r).alias("reason"), source_age_hours().alias("source_age_hours")).alias("v"))) for k, (c, r) in reasons.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def _hint(name: str) -> Column:
    """A hint as a number; 0 counts as not given, as it does in the defaults that follow."""
    return F.nullif(F.element_at("hints", name).cast("double"), F.lit(0.0))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def calibrate(raw: Column, kind: str) -> Column:
    slope, bias = CALIBRATION[kind]
    return F.round(clamp(raw * slope + bias, 0.0, 1.0), 6)


def text_features() -> Column:
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    seen = F.trim(F.coalesce(F.element_at("hints", "video_caption"), F.lit("")))
    tokens = words(F.concat_ws(" ", "caption", "transcript_text", "ocr_text", seen, F.array_join(listed("hashtags"), " "), F.array_join(listed("keywords"), " ")))
    n, unique = F.size(tokens), F.size(F.array_distinct(tokens))
    cta = F.size(F.filter(tokens, lambda t: t.isin(CTA_TERMS)))
    clarity = clamp(0.42 + unique / F.greatest(n, F.lit(1)) * 0.5 + F.when(cta > 0, 0.04).otherwise(0.0), 0.0, 1.0)
    sure = clamp(0.62 + 0.08 * (~_blank("transcript_text")).cast("int") + 0.06 * (~_blank("ocr_text")).cast("int") + 0.08 * (seen != "").cast("int"), 0.0, 1.0)
    missing = _missing(transcript_text=(_blank("transcript_text"), "not_available"), ocr_text=(_blank("ocr_text"), "not_available"), caption=(_blank("caption"), "low_quality"), keyphrase_count=(F.size(listed("keywords")) == 0, "not_available"), token_count=(n <= 2, "low_quality"))
    return F.struct(n.alias("token_count"), unique.alias("unique_token_count"), F.size(listed("hashtags")).alias("hashtag_count"), F.least(F.size(listed("keywords")), F.lit(32)).alias("keyphrase_count"), cta.alias("cta_keyword_count"), F.round(clarity, 6).alias("clarity_score"), calibrate(sure, "text").alias("confidence"), missing.alias("missing"))


def structure_features() -> Column:
    duration = F.coalesce(F.col("duration_seconds"), F.greatest(F.lit(10), F.least(F.lit(180), F.size(words("caption")) * 2)))
    kind = F.lower(F.coalesce(F.nullif(F.trim("content_type"), F.lit("")), F.lit("tutorial")))
    share = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in WINDOWS.items() for x in (k, v[i])]), kind), F.lit(WINDOWS["tutorial"][i]))
    hook = F.round(F.greatest(F.lit(1.0), duration * share(0)), 4)
    payoff = F.round(F.greatest(hook + 2.0, duration * share(1)), 4)
    step = F.round(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) / F.greatest(duration / 10.0, F.lit(1.0)), 6)
    pace = clamp(0.5 + F.least(duration, F.lit(90)) / 180 + F.least(step, F.lit(2.0)) / 6, 0.0, 1.0)
    missing = _missing(duration_seconds=(F.col("duration_seconds").isNull(), "not_available"), content_type=(_blank("content_type"), "not_available"))
    mid_end = F.greatest(hook, payoff - 0.5)
    return F.struct(
        F.lit(0.0).alias("hook_window_start_sec"), hook.alias("hook_window_end_sec"), hook.alias("mid_window_start_sec"), F.round(mid_end, 4).alias("mid_window_end_sec"),
        payoff.alias("payoff_window_start_sec"), F.round(duration.cast("double"), 4).alias("payoff_window_end_sec"), hook.alias("hook_timing_seconds"), payoff.alias("payoff_timing_seconds"),
        step.alias("step_density"), F.round(pace, 6).alias("pacing_score"), calibrate(0.66 + F.when(F.col("duration_seconds").isNotNull(), 0.08).otherwise(0.0), "structure").alias("confidence"), missing.alias("missing"),
    )


def _without(names: tuple[str, ...]) -> Column:
    return _missing(**{n: (F.lit(True), "not_available") for n in names})


def _none_missing() -> Column:
    return _missing(none=(F.lit(False), ""))


def _has_any(*names: str) -> Column:
    any_ = F.lit(False)
    for n in names:
        any_ = any_ | F.coalesce(F.map_contains_key("hints", n), F.lit(False))
    return any_


def audio_features() -> Column:
    """Speech, tempo and energy from the hints ``speech_seconds music_seconds tempo_bpm audio_energy``; without any, nothing."""
    given = _has_any("speech_seconds", "music_seconds", "tempo_bpm", "audio_energy")
    duration = F.coalesce(F.nullif(F.col("duration_seconds").cast("double"), F.lit(0.0)), F.lit(30.0))
    speech = F.coalesce(_hint("speech_seconds"), duration * 0.55)
    music = F.coalesce(_hint("music_seconds"), F.greatest(duration - speech, F.lit(0.0)))
    ratio = clamp(speech / F.greatest(speech + music, F.lit(1.0)), 0.0, 1.0)
    tempo = F.coalesce(_hint("tempo_bpm"), F.lit(108.0))
    energy = clamp(F.coalesce(_hint("audio_energy"), (tempo - 70.0) / 120.0), 0.0, 1.0)
    when = lambda x: F.when(given, F.round(x, 6))
    missing = F.when(given, _none_missing()).otherwise(_without(("speech_ratio", "tempo_bpm", "energy", "music_presence_score")))
    return F.struct(when(ratio).alias("speech_ratio"), when(tempo).alias("tempo_bpm"), when(energy).alias("energy"), when(clamp(1.0 - ratio + 0.2, 0.0, 1.0)).alias("music_presence_score"), calibrate(F.when(given, 0.76).otherwise(0.3), "audio").alias("confidence"), missing.alias("missing"))


def visual_features() -> Column:
    """Shot rate, motion and style from the hints ``estimated_scene_cuts visual_motion_score fps``; without any, nothing."""
    given = _has_any("estimated_scene_cuts", "visual_motion_score", "fps")
    duration = F.coalesce(F.nullif(F.col("duration_seconds").cast("double"), F.lit(0.0)), F.lit(30.0))
    rate = F.greatest(F.coalesce(_hint("estimated_scene_cuts"), F.lit(12.0)), F.lit(1.0)) / F.greatest(duration, F.lit(1.0))
    motion = clamp(F.coalesce(_hint("visual_motion_score"), rate / 1.8), 0.0, 1.0)
    pace = F.when(rate >= 0.5, "rapid_cut").when(rate <= 0.22, "slow_cut").otherwise("balanced_cut")
    frame = F.when(motion >= 0.7, "high_motion").when(motion <= 0.35, "static_framing")
    tags = F.when(given, F.array_compact(F.array(pace, frame))).otherwise(F.array().cast("array<string>"))
    missing = F.when(given, _none_missing()).otherwise(_without(("shot_change_rate", "visual_motion_score")))
    return F.struct(F.when(given, F.round(rate, 6)).alias("shot_change_rate"), F.when(given, F.round(motion, 6)).alias("visual_motion_score"), tags.alias("style_tags"), calibrate(F.when(given, 0.78).otherwise(0.3), "visual").alias("confidence"), missing.alias("missing"))


EXTRACTORS: dict[str, Callable[[], Column]] = {"text": text_features, "structure": structure_features, "audio": audio_features, "visual": visual_features}


def extract(posts: DataFrame, kinds: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """One struct column per registered extractor, all in one projection.

    Posts need caption, transcript_text, ocr_text, hashtags, keywords, duration_seconds,
    content_type, a map ``hints``, as_of_time and source_updated_at.
    """
    return posts.select("*", *[EXTRACTORS[k]().alias(f"{k}_features") for k in kinds])


def missing_by_reason(features: DataFrame, kinds: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    maps = F.explode(F.flatten(F.array(*[F.map_entries(f"{k}_features.missing") for k in kinds])))
    return features.select(maps.alias("e")).groupBy(F.col("e.key").alias("feature"), F.col("e.value.reason").alias("reason")).agg(F.count("*").alias("n"))


def fit_calibration(scored: DataFrame, score: str, z: str, bins: int = 10) -> DataFrame:
    """Slope and bias of ``sigmoid(z)`` on the score, over about equal-count bins of the score."""
    from skein.functions.scalars import sigmoid

    cuts = scored.agg(F.percentile_approx(score, [i / bins for i in range(1, bins)], 10_000).alias("cuts"))
    b = scored.crossJoin(F.broadcast(cuts)).select(F.size(F.filter("cuts", lambda c: c < F.col(score))).alias("bin"), F.col(score).alias("x"), sigmoid(z).alias("y"))
    means = b.groupBy("bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return means.agg(F.coalesce(F.regr_slope("y", "x"), F.lit(1.0)).alias("slope"), F.coalesce(F.regr_intercept("y", "x"), F.lit(0.0)).alias("bias"), F.sum("n").alias("n"))


# Per content type the speech share, motion bias, tempo, energy, hook and payoff shares, audio and visual style.
SIGNALS = {
    "tutorial": (0.65, -0.05, 105, 0.52, 0.10, 0.80, "voice_forward", "instructional_pacing"),
    "dance": (0.12, 0.25, 128, 0.82, 0.05, 0.60, "music_forward", "high_motion"),
    "comedy": (0.55, 0.05, 115, 0.62, 0.08, 0.70, "voice_forward", "reactive_pacing"),
    "gaming": (0.45, 0.15, 120, 0.70, 0.06, 0.75, "mixed_audio", "screen_capture_motion"),
    "cooking": (0.50, -0.08, 100, 0.45, 0.12, 0.85, "voice_forward", "slow_reveal_pacing"),
    "fitness": (0.35, 0.18, 130, 0.78, 0.07, 0.65, "music_forward", "high_motion"),
    "travel": (0.30, 0.08, 110, 0.60, 0.10, 0.72, "music_forward", "cinematic_pacing"),
    "music": (0.10, 0.10, 120, 0.88, 0.05, 0.55, "music_forward", "performance_pacing"),
    "news": (0.80, -0.15, 95, 0.40, 0.08, 0.90, "voice_forward", "static_framing"),
    "lifestyle": (0.48, 0.0, 108, 0.55, 0.12, 0.75, "mixed_audio", "balanced_motion"),
}
OTHER_SIGNALS = (0.50, 0.0, 118, 0.55, 0.12, 0.72, "mixed_audio", "balanced_motion")


def signal_fallback(posts: DataFrame) -> DataFrame:
    """The signals of posts without extractors, from the type's profile, the number of tokens and the hints that are there.

    Needs text, content_type and a map ``hints``. Text is compared in lower case without
    punctuation; the numbers in the expressions are fixed values.
    """
    schema = "kind string, speech double, motion double, tempo double, energy double, hook double, payoff double, audio_style string, visual_style string"
    rows = [(k, *map(float, v[:6]), *v[6:]) for k, v in SIGNALS.items()]
    profile = posts.sparkSession.createDataFrame(rows, schema)
    names = schema.replace(",", "").split()[2::2]
    default = dict(zip(names, OTHER_SIGNALS, strict=True))
    p = posts.join(F.broadcast(profile), F.lower("content_type") == F.col("kind"), "left").withColumns({n: F.coalesce(n, F.lit(float(v) if not isinstance(v, str) else v)) for n, v in default.items()})
    hint = lambda k: F.element_at("hints", k).cast("double")
    bound = lambda x, low, high: F.least(F.lit(high) if not isinstance(high, Column) else high, F.greatest(F.lit(low), x))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", " "), r"(?U)\s+", " "))
    p = p.withColumn("plain", plain).withColumn("tokens", F.filter(F.split("plain", " "), lambda w: F.length(w) >= 2))
    n, unique = F.size("tokens"), F.size(F.array_distinct("tokens"))
    p = p.withColumn("duration", bound(F.round(F.coalesce(hint("duration_seconds"), F.lit(35.0))), 8.0, 600.0))
    cuts = bound(F.round(F.coalesce(hint("estimated_scene_cuts"), F.greatest(F.lit(8.0), n * 0.5))), 4.0, 80.0)
    p = p.withColumn("shot_change_rate", F.round(cuts / F.col("duration"), 4))
    p = p.withColumn("visual_motion_score", F.round(clamp(F.coalesce(hint("visual_motion_score"), F.col("shot_change_rate") / 1.8) + F.col("motion"), 0.0, 1.0), 4))
    p = p.withColumn("speech_ratio", F.round(clamp(F.coalesce(hint("speech_seconds") / F.col("duration"), F.col("speech")), 0.0, 1.0), 4))
    return p.select(
        *posts.columns, "duration", "shot_change_rate", "visual_motion_score", "speech_ratio", n.alias("token_count"), unique.alias("unique_token_count"), F.round(clamp(unique / F.greatest(n, F.lit(1)) + 0.35, 0.0, 1.0), 4).alias("clarity_score"),
        F.round(clamp(F.col("shot_change_rate") * 0.8 + F.col("speech_ratio") * 0.2, 0.0, 1.0), 4).alias("pacing_score"), F.round(bound(F.col("duration") * F.col("hook"), 0.5, 8.0), 2).alias("hook_timing_seconds"), F.round(bound(F.col("duration") * F.col("payoff"), 3.0, F.col("duration")), 2).alias("payoff_timing_seconds"),
        F.round(bound(F.coalesce(hint("tempo_bpm"), F.col("tempo")), 60.0, 220.0), 2).alias("tempo_bpm"), F.round(clamp(F.coalesce(hint("audio_energy"), F.col("energy")), 0.0, 1.0), 4).alias("audio_energy"), F.round(clamp(1 - F.col("speech_ratio"), 0.0, 1.0), 4).alias("music_presence_score"),
        F.when(F.col("visual_motion_score") > 0.55, "high_motion").otherwise(F.col("visual_style")).alias("visual_style_tag"), F.when(F.col("speech_ratio") >= 0.55, "voice_forward").otherwise(F.col("audio_style")).alias("audio_style_tag"),
        F.filter(F.array(*[F.lit(t) for t in ("follow", "comment", "save", "share", "link", "bio")]), lambda t: F.contains("plain", t)).alias("cta_keywords"),
    )
