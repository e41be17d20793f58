"""Descriptive statistics, scorecards, drift measures and calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: count, min, p10, median, mean, p90, max, with interpolated exact quantiles; one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m")).select("m.*").filter("x is not null")
    q = lambda p: F.percentile("x", F.lit(p))
    return long.groupBy("metric").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.round(q(0.1), 6).alias("p10"), F.round(q(0.5), 6).alias("median"), F.round(F.avg("x"), 6).alias("mean"), F.round(q(0.9), 6).alias("p90"), F.max("x").alias("max"))


def distribution_profile(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, population deviation, p50 and p95 of each group."""
    return df.groupBy(group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"))


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Per group the value at place ``round((n - 1) * q)``, ties to even, of its sorted values.

    From counts per distinct value and a running sum, so no group's values are collected.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    run = per.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*group).orderBy(value))).withColumn("_n", F.sum("_c").over(Window.partitionBy(*group)))
    return run.filter(F.col("_upto") > F.bround((F.col("_n") - 1) * q, 0)).groupBy(*group).agg(F.min(value).alias(out))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per pair of columns: correlation, null where it is not defined."""
    agg = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.when(~F.isnan(f"c{i}"), F.round(f"c{i}", 6)).alias("r")) for i, (a, b) in enumerate(pairs)]
    return agg.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Population skewness and excess kurtosis of each group."""
    return df.groupBy(group).agg(F.round(F.skewness(value), 5).alias("skewness"), F.round(F.kurtosis(value), 5).alias("kurtosis"))


def iqr_outliers(df: DataFrame, value: Column) -> DataFrame:
    """Quartiles, fences at 1.5 IQR and the number outside, for one expression."""
    x = df.select(value.alias("x")).filter("x is not null")
    q = x.agg(F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))
    out = (F.col("x") < F.col("q1") - 1.5 * F.col("iqr")) | (F.col("x") > F.col("q3") + 1.5 * F.col("iqr"))
    return x.crossJoin(F.broadcast(q)).agg(F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("q3"), 6).alias("q3"), F.count_if(out).alias("n_outliers"))


def scorecard(df: DataFrame, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Null and zero rates of each column and the duplicate rate of the key (null keys are one value).

    The key's distinct count is taken by grouping, so it never sits in one task.
    """
    n = F.count("*")
    rates = df.agg(n.alias("n"), *[F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in columns], *[F.avg(F.coalesce((F.col(c).cast("string") == "0").cast("int"), F.lit(0))).alias(f"zero_{c}") for c in columns])
    keys = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.count("*").alias("k"))
    rows = [F.struct(F.lit(c).alias("name"), F.round(f"null_{c}", 6).alias("null_rate"), F.round(f"zero_{c}", 6).alias("zero_rate"), F.round((F.col("n") - F.col("k")) / F.greatest("n", F.lit(1)), 6).alias("duplicate_rate")) for c in columns]
    return rates.crossJoin(keys).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _two(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    return reference.select(F.lit("").alias("name"), F.lit(0).alias("s"), F.col(value).cast("double").alias("x")).unionByName(current.select(F.lit("").alias("name"), F.lit(1).alias("s"), F.col(value).cast("double").alias("x"))).filter("x is not null")


#: Fixed value: the least share of a bin.
PSI_FLOOR = 1e-9


def psi_by_name(samples: DataFrame, bins: int = 10) -> DataFrame:
    """(name, n_reference, n_current, psi) of samples (name, s, x), ``s`` 0 for the reference and 1 for now.

    Population stability over equal bins of the joint range, both ends of a bin inclusive, so
    a value on an inner edge counts in both of its bins. 0 where a sample is empty or all
    values are equal. The counts are one aggregate of both samples; only ``bins`` pairs of
    shares are compared.
    """
    span = samples.groupBy("name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = samples.join(span, "name").withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    low = lambda i: F.col("lo") + F.col("step") * i
    high = lambda i: F.col("hi") if i == bins - 1 else low(i) + F.col("step")
    counts = [F.count_if((F.col("s") == s) & (F.col("x") >= low(i)) & (F.col("x") <= high(i))).alias(f"c{s}_{i}") for s in (0, 1) for i in range(bins)]
    c = j.groupBy("name").agg(F.count_if(F.col("s") == 0).alias("n_reference"), F.count_if(F.col("s") == 1).alias("n_current"), F.max("step").alias("step"), *counts)
    total = F.lit(0.0)
    for i in range(bins):
        p, q = (F.greatest(F.col(f"c{s}_{i}") / F.greatest(F.col(n), F.lit(1)), F.lit(PSI_FLOOR)) for s, n in ((0, "n_reference"), (1, "n_current")))
        total = total + (q - p) * F.log(q / p)
    undefined = (F.col("n_reference") == 0) | (F.col("n_current") == 0) | (F.col("step") <= 0)
    return c.select("name", "n_reference", "n_current", F.when(undefined, 0.0).otherwise(total).alias("psi"))


def ks_by_name(samples: DataFrame) -> DataFrame:
    """(name, ks): largest distance of the two empirical distributions, 0 where a sample is empty.

    From counts per value and running sums over ranges of the values; the names are few.
    """
    from skein.operators.windows import running_before

    per = samples.groupBy("name", "x").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))
    run = running_before(per, "x", {"ca": ("sum", "a"), "cb": ("sum", "b")}, ["name"])
    n = samples.groupBy(F.col("name").alias("_name")).agg(F.count_if(F.col("s") == 0).alias("na"), F.count_if(F.col("s") == 1).alias("nb"))
    gap = F.abs((F.col("ca") + F.col("a")) / F.greatest("na", F.lit(1)) - (F.col("cb") + F.col("b")) / F.greatest("nb", F.lit(1)))
    return run.join(F.broadcast(n), F.col("name") == F.col("_name")).groupBy("name").agg(F.max(F.when((F.col("na") > 0) & (F.col("nb") > 0), gap).otherwise(0.0)).alias("ks"))


def mean_delta_by_name(samples: DataFrame) -> DataFrame:
    """(name, mean_delta): difference of the means in shares of the reference's; where that is 0, 0 or 1."""
    m = samples.groupBy("name").agg(F.avg(F.when(F.col("s") == 0, F.col("x"))).alias("r"), F.avg(F.when(F.col("s") == 1, F.col("x"))).alias("c"))
    none = F.abs("r") <= 1e-9
    delta = F.when(F.col("r").isNull() | F.col("c").isNull(), 0.0).when(none & (F.abs("c") <= 1e-9), 0.0).when(none, 1.0).otherwise(F.abs(F.col("c") - F.col("r")) / F.abs("r"))
    return m.select("name", delta.alias("mean_delta"))


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    return psi_by_name(_two(reference, current, value), bins).select("psi")


def ks(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    return ks_by_name(_two(reference, current, value)).select("ks")


def mean_delta(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    return mean_delta_by_name(_two(reference, current, value)).select("mean_delta")


#: What a measure must exceed for a breach, and the least sample on either side.
DRIFT_LIMITS = {"psi_mandatory": 0.20, "psi_optional": 0.30, "ks": 0.12, "mean_delta": 0.20, "min_samples": 25}
#: The same for the rates of the serving policy.
POLICY_LIMITS = {"fallback_rate": 0.05, "fallback_delta": 0.02, "author_cap_drop_rate": 0.20, "strict_language_drop_rate": 0.20, "strict_locale_drop_rate": 0.20}


def drift_measures(features: DataFrame, labels: DataFrame, least: int = DRIFT_LIMITS["min_samples"]) -> DataFrame:
    """(stream, name, n_reference, n_current, psi, ks, mean_delta, sufficient, breach), one row a metric.

    ``features`` and ``labels``: samples (name, s, x). A feature breaches by its PSI, with a
    limit by its prefix ``mandatory_`` or ``optional_``; a label by its KS distance or mean.
    """
    enough = F.least("n_reference", "n_current") >= least
    limit = F.when(F.col("name").startswith("mandatory_"), DRIFT_LIMITS["psi_mandatory"]).when(F.col("name").startswith("optional_"), DRIFT_LIMITS["psi_optional"])
    nothing = F.lit(None).cast("double")
    f = psi_by_name(features).select(F.lit("feature").alias("stream"), "name", "n_reference", "n_current", F.round("psi", 6).alias("psi"), nothing.alias("ks"), nothing.alias("mean_delta"), enough.alias("sufficient"), F.coalesce(enough & (F.col("psi") > limit), F.lit(False)).alias("breach"))
    n = labels.groupBy("name").agg(F.count_if(F.col("s") == 0).alias("n_reference"), F.count_if(F.col("s") == 1).alias("n_current"))
    m = n.join(ks_by_name(labels), "name").join(mean_delta_by_name(labels), "name")
    over = (F.col("ks") > DRIFT_LIMITS["ks"]) | (F.col("mean_delta") > DRIFT_LIMITS["mean_delta"])
    return f.unionByName(m.select(F.lit("label").alias("stream"), "name", "n_reference", "n_current", nothing.alias("psi"), F.round("ks", 6).alias("ks"), F.round("mean_delta", 6).alias("mean_delta"), enough.alias("sufficient"), (enough & over).alias("breach")))


def drift_summary(features: DataFrame, labels: DataFrame, policy: DataFrame, least: int = DRIFT_LIMITS["min_samples"]) -> DataFrame:
    """One row: the breaches by stream, severity and recommendation.

    ``policy``: one row with the counts ``baseline_n`` and ``current_n``, ``baseline_fallback_rate``
    and the current rates named in ``POLICY_LIMITS``.
    """
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    is_feature, starts = F.col("stream") == "feature", F.col("name").startswith
    seen = drift_measures(features, labels, least).agg(
        some(is_feature & starts("mandatory_") & F.col("breach")).alias("feature_mandatory"), some(is_feature & starts("optional_") & F.col("breach")).alias("feature_optional"),
        some(~is_feature & F.col("breach")).alias("label"), some(is_feature & F.col("sufficient")).alias("_f"), some(~is_feature & F.col("sufficient")).alias("_l"),
    )
    rate = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    over = rate("fallback_rate") - rate("baseline_fallback_rate") > POLICY_LIMITS["fallback_delta"]
    for name, limit in POLICY_LIMITS.items():
        if name != "fallback_delta":
            over = over | (rate(name) > limit)
    enough = F.least(F.coalesce("baseline_n", F.lit(0)), F.coalesce("current_n", F.lit(0))) >= least
    all_ = seen.crossJoin(policy.select((enough & over).alias("policy"), enough.alias("_p")))
    severity = F.when(F.col("feature_mandatory") | F.col("label") | F.col("policy"), "critical").when(F.col("feature_optional"), "warning").when(~(F.col("_f") & F.col("_l") & F.col("_p")), "insufficient_data").otherwise("ok")
    advice = F.when(F.col("severity") == "critical", "retrain_candidate").when(F.col("severity") == "warning", "monitor").when(F.col("severity") == "insufficient_data", "insufficient_data").otherwise("none")
    return all_.withColumn("severity", severity).select("feature_mandatory", "feature_optional", "label", "policy", (F.col("_f") & F.col("_l") & F.col("_p")).alias("sufficient"), "severity", advice.alias("recommendation"))


def regression_metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """MAE, RMSE, R2 and the rank correlation with ties at their mean rank."""
    from skein.operators.windows import average_rank

    e = F.col(truth) - F.col(guess)
    r = average_rank(average_rank(df.select(truth, guess), truth, "_ra"), guess, "_rb")
    return r.agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(1 - F.avg(e * e) / F.var_pop(truth), 6).alias("r2"), F.round(F.corr("_ra", "_rb"), 6).alias("spearman"),
    )


def linear_calibration(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Slope and bias of the least-squares line of each group; slope 1 and bias 0 where x does not vary."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.coalesce(F.regr_slope(y, x), F.lit(1.0)), 6).alias("slope"), F.round(F.coalesce(F.regr_intercept(y, x), F.lit(0.0)), 6).alias("bias"))
