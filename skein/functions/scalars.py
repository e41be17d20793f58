"""Scalar expressions: guarded arithmetic, scores, hashing, vectors, maps and times."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a, b, default: float = 0.0) -> Column:
    """``a / b``, the default where b is 0 or null."""
    b = _c(b)
    return F.when((b == 0) | b.isNull(), F.lit(default)).otherwise(_c(a) / b)


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def round6(x) -> Column:
    """Rounding to 6 places, ties to even."""
    return F.bround(_c(x), 6)


def zscore(x, mean, std) -> Column:
    return F.when(_c(std) == 0, F.lit(0.0)).otherwise((_c(x) - _c(mean)) / _c(std))


def softmax3(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Shifted by the largest, so that no exponential overflows."""
    top = F.greatest(a, b, c)
    a, b, c = F.exp(a - top), F.exp(b - top), F.exp(c - top)
    return a / (a + b + c), b / (a + b + c), c / (a + b + c)


def argmax3(a: Column, b: Column, c: Column, names: Sequence[str]) -> Column:
    """The name of the largest of three, ties to the first."""
    return F.when((a >= b) & (a >= c), names[0]).when(b >= c, names[1]).otherwise(names[2])


def regime_logits(early, late, ratio, stability) -> tuple[Column, Column, Column]:
    """Scores of the regimes spike, balanced and durable. The coefficients are fixed values."""
    early, late, ratio, stability = _c(early), _c(late), _c(ratio), _c(stability)
    pos = lambda x: F.greatest(x, F.lit(0.0))
    spike = 1.4 * pos(early) + 0.8 * pos(-late) + 0.7 * pos(0.35 - ratio)
    balanced = F.greatest(F.lit(0.05), 1.0 - F.abs(early - late) - F.abs(ratio - 0.5) + 0.2 * pos(stability))
    durable = 1.3 * pos(late) + 0.9 * pos(ratio) + 0.5 * pos(stability)
    return spike, balanced, durable


def relevance_label(z) -> Column:
    """Labels 3..0 by the fixed thresholds 1.0, 0.3 and -0.3."""
    z = _c(z)
    return F.when(z >= 1.0, 3).when(z >= 0.3, 2).when(z >= -0.3, 1).otherwise(0)


def follower_bucket(n) -> Column:
    """Limits and names of author sizes; an unknown number counts as 0."""
    n = F.coalesce(_c(n), F.lit(0))
    return F.when(n < 10_000, "nano").when(n < 100_000, "micro").when(n < 1_000_000, "macro").otherwise("mega")


def shares_per_thousand(shares, views) -> Column:
    return F.log1p(_c(shares) * 1000 / F.greatest(_c(views), F.lit(1)))


def engagement_total(likes, comments, shares) -> Column:
    return F.coalesce(_c(likes), F.lit(0)) + F.coalesce(_c(comments), F.lit(0)) + F.coalesce(_c(shares), F.lit(0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return safe_div(dot(a, b), norm(a) * norm(b))


def unit_interval(seed) -> Column:
    """A text's hash as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(_c(seed), 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def variant_bucket(seed, ratio: float) -> Column:
    return F.when(unit_interval(seed) < ratio, "treatment").otherwise("control")


def signed_hash_slot(token, dims: int) -> tuple[Column, Column]:
    """Slot and sign of a token in a signed hash embedding."""
    h = F.sha2(_c(token), 256)
    slot = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dims
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)
    return slot, sign


def half_life(age, life: float) -> Column:
    """``2 ** (-age / life)``."""
    return F.exp(-math.log(2) / life * _c(age))


def backoff_seconds(base: float, attempts, cap: float = 21600.0) -> Column:
    """Exponential retry delay, capped at six hours."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), _c(attempts) - 1), F.lit(cap))


def hours_between(later, earlier) -> Column:
    """Difference in hours, 4 places."""
    return F.round((F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / 3.6e9, 4)


def parse_iso(x) -> Column:
    """ISO text to a UTC timestamp; without a zone it is UTC, invalid text is null."""
    return F.try_to_timestamp(_c(x))


def format_iso(t) -> Column:
    return F.date_format(_c(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def month_shard(t) -> Column:
    return F.date_format(_c(t), "yyyy-MM")


def cyclic_hour(t) -> tuple[Column, Column]:
    angle = F.hour(_c(t)) * (2 * math.pi / 24)
    return F.sin(angle), F.cos(angle)


def top_of_map(m, n: int) -> Column:
    """The n largest entries of a map, ties by key; values that differ by the order of a sum alone (9 places) are ties."""
    key = lambda e: F.struct((-F.round(e["value"], 9)).alias("v"), e["key"].alias("k"), e["value"].alias("x"))
    ordered = F.array_sort(F.transform(F.map_entries(_c(m)), key))
    return F.map_from_entries(F.transform(F.slice(ordered, 1, n), lambda e: F.struct(e["k"], e["x"])))


def merge_maps(a, b) -> Column:
    """Sums of two maps' values by key."""
    return F.map_zip_with(_c(a), _c(b), lambda k, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def normalise_weights(m, default: dict[str, float]) -> Column:
    """Weights clipped at 0 that add up to 1, or the default where none is positive."""
    clipped = F.transform_values(_c(m), lambda k, v: F.greatest(v, F.lit(0.0)))
    total = F.aggregate(F.map_values(clipped), F.lit(0.0), lambda s, x: s + x)
    fallback = F.create_map(*[F.lit(x) for kv in default.items() for x in kv])
    return F.when(total > 0, F.transform_values(clipped, lambda k, v: v / total)).otherwise(fallback)


def sigmoid(z) -> Column:
    return 1 / (1 + F.exp(-_c(z)))


def canonical_hash(*columns: str) -> Column:
    """sha256 of the columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
