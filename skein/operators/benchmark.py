"""Benchmarks with human labels: summaries, metrics of ranked lists, choice of cases, held-out trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("good", "unclear", "bad")
#: The relevance of a label, and the regime that goes with an objective.
RELEVANCE = {"good": 2.0, "unclear": 1.0, "bad": 0.0}
REGIME = {"reach": "spike", "engagement": "balanced", "conversion": "durable"}


def summary(candidates: DataFrame) -> DataFrame:
    """One row for rows (case_id, objective, candidate_id, label): cases, candidates, labels and preferences.

    Preferences are pairs of a case's candidates with different labels, from the counts alone.
    """
    known = F.col("label").isin(list(LABELS))
    per = candidates.groupBy("case_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(x) for x in LABELS], F.count_if(~F.coalesce(known, F.lit(False))).alias("unlabeled"))
    pairs = F.col("good") * F.col("unclear") + F.col("good") * F.col("bad") + F.col("unclear") * F.col("bad")
    return per.agg(F.count("*").alias("cases"), F.sum("n").alias("candidates"), *[F.sum(x).alias(x) for x in (*LABELS, "unlabeled")], F.sum(pairs).alias("preferences"))


def case_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """Per case of rows (case_id, candidate_id, position, label): label rates, NDCG, reciprocal rank and recall at k.

    Reciprocal rank and recall are null where a case has no good label.
    """
    relevance = F.coalesce(*[F.when(F.col("label") == x, v) for x, v in RELEVANCE.items()], F.lit(0.0))
    ideal = Window.partitionBy("case_id").orderBy(relevance.desc(), "candidate_id")
    r = ranked.withColumn("_rel", relevance).withColumn("_i", F.row_number().over(ideal))
    top = F.col("position") <= k
    gain = F.pow(F.lit(2.0), F.col("_rel")) - 1
    shown, good = F.count_if(top), F.count_if(F.col("label") == "good")
    rate = lambda x: F.when(shown > 0, F.count_if(top & (F.col("label") == x)) / shown)
    dcg, best = F.sum(F.when(top, gain / F.log2(F.col("position") + 1.0)).otherwise(0.0)), F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1.0)).otherwise(0.0))
    return r.groupBy("case_id").agg(
        (good > 0).cast("double").alias("has_good_labels"), *[F.round(rate(x), 6).alias(f"{x}_rate") for x in LABELS], F.round(F.when(best > 0, dcg / best).otherwise(0.0), 6).alias("ndcg"),
        F.round(F.when(good > 0, F.coalesce(F.max(F.when(top & (F.col("label") == "good"), 1.0 / F.col("position"))), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.when(good > 0, F.count_if(top & (F.col("label") == "good")) / good), 6).alias("recall"),
    )


def aggregate_metrics(cases: DataFrame) -> DataFrame:
    """Mean of each metric over the cases that have it."""
    return cases.agg(*[F.round(F.avg(c), 6).alias(c) for c in cases.columns if c != "case_id"])


def select_cases(rows: DataFrame, ident: str, at: str, topic: str, objectives: Sequence[str], n: int, seed: int, least_history: int, per_topic: int) -> DataFrame:
    """``n`` query rows in a seeded order, at most ``per_topic`` of a topic, then others until there are ``n``.

    Rows need ``least_history`` earlier ones. Returns ident, topic, position and the objective,
    dealt in turn. The order is a hash; the n-th earliest time is one small sort of the head.
    """
    head = rows.filter(F.col(at).isNotNull()).orderBy(at).limit(least_history).agg(F.max(at).alias("_from"), F.count("*").alias("_have"))
    ready = rows.crossJoin(F.broadcast(head)).filter((F.col("_have") >= least_history) & (F.col(at) > F.col("_from")))
    draw = ready.select(F.col(ident), F.col(topic), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), 256).alias("_h"))
    w = Window.partitionBy(topic).orderBy("_h")
    ranked = draw.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).withColumn("_over", (F.col("_r") > per_topic).cast("int"))
    chosen = ranked.orderBy("_over", "_h").limit(n)  # a bounded list from here on
    pos = F.row_number().over(Window.orderBy("_over", "_h"))
    turn = F.get(F.array(*[F.lit(o) for o in objectives]), (F.col("position") - 1) % len(objectives))
    return chosen.withColumn("position", pos).select(ident, topic, F.col("position").cast("long").alias("position"), turn.alias("objective"))


def trajectory_eval(rows: DataFrame, k: int) -> DataFrame:
    """Per objective of rows (objective, item, spike, balanced, durable, confidence, z): NDCG and reciprocal rank at k.

    The score is the probability of the objective's regime times the confidence; relevance are
    the quartile grades of z.
    """
    from skein.operators.windows import quartile_grades

    prob = F.coalesce(*[F.when(F.col("objective") == o, F.col(r)) for o, r in REGIME.items()], F.lit(0.0))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    graded = quartile_grades(rows.filter("z is not null").withColumn("score", unit(prob) * unit(F.coalesce("confidence", F.lit(0.0)))), "objective", "z", "grade")
    got, ideal = Window.partitionBy("objective").orderBy(F.desc("score"), "item"), Window.partitionBy("objective").orderBy(F.desc("grade"), "item")
    # only the heads of the two rankings are needed
    a = graded.withColumn("r", F.row_number().over(got)).filter(F.col("r") <= k)
    b = graded.withColumn("i", F.row_number().over(ideal)).filter(F.col("i") <= k)
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    dcg = a.groupBy("objective").agg(F.sum(gain / F.log2(F.col("r") + 1.0)).alias("dcg"), F.coalesce(F.max(F.when(F.col("grade") > 0, 1.0 / F.col("r"))), F.lit(0.0)).alias("mrr"))
    best = b.groupBy("objective").agg(F.sum(gain / F.log2(F.col("i") + 1.0)).alias("best"))
    n = graded.groupBy("objective").agg(F.count("*").alias("n_rows"))
    return n.join(dcg, "objective").join(best, "objective").select("objective", "n_rows", F.round(F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0), 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"))
