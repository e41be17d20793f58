"""Closed forms and properties of operators that the plans do not pin."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import scalars
from skein.functions import scalars as S
from skein.functions import text as T
from skein.operators import asof, contracts, datamart, evaluation, experiments, fabric, graph, lineage, medallion, ranking, retrieval, similarity, stats, tags, upsert, walks, windows
from skein.sources import extracts, jsonl, manifest


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_guards(spark):
    assert one(spark, S.safe_div(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, S.zscore(F.lit(5.0), F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, S.relevance_label(F.lit(0.3))) == 2
    assert one(spark, S.backoff_seconds(60.0, F.lit(30))) == 21600.0
    assert one(spark, S.normalise_weights(F.create_map(F.lit("a"), F.lit(-1.0)), {"z": 1.0})) == {"z": 1.0}
    assert list(one(spark, S.top_of_map(F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(3.0), F.lit("c"), F.lit(2.0)), 2))) == ["b", "c"]


def test_top_of_map_ties_do_not_hang_on_the_order_of_a_sum(spark):
    m = F.create_map(F.lit("a"), F.lit(0.6), F.lit("b"), F.lit(0.1) + F.lit(0.2) + F.lit(0.3), F.lit("c"), F.lit(0.3) + F.lit(0.2) + F.lit(0.1))
    assert one(spark, S.top_of_map(m, 1)) == {"a": 0.6}


def test_text(spark):
    assert one(spark, T.clean_caption(F.lit("see https://x.y/z @me #Tag  now"))) == "see now"
    assert one(spark, T.hashtags(F.lit("#A b #a #Ü"))) == ["#a", "#ü"]
    assert one(spark, T.intent(F.lit("how much is it?"))) == "confusion"
    assert one(spark, T.intent(F.lit("how much"))) == "help_seeking"
    assert one(spark, T.intent(F.lit("nothing here"))) == "off_topic"
    assert one(spark, T.sentiment(F.lit("great great bad thing"))) == 0.0
    assert one(spark, T.tag_jaccard(F.lit("#abc"), F.lit("#abc"))) == 1.0
    assert one(spark, T.combined_hashtags(F.lit("x #b"), F.array(F.lit("B"), F.lit("#c")))) == ["#b", "#c"]
    assert one(spark, T.strip_html(F.lit("<p>a &amp; b</p><script>x</script>"))) == "a & b"
    assert one(spark, T.normalise_url(F.lit("HTTPS://Ex.org/A/?q=1"))) == "https://ex.org/A"
    assert one(spark, T.nfkc(F.lit("ﬁ"))) == "fi"


def test_set_similarity_is_exact(spark):
    sets = {i: {j for j in range(40) if (i * 7 + j * j) % (3 + i % 4) == 0} for i in range(30)}
    df = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "k long, e long")
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.set_similarity_pairs(df, "k", "e", 0.6).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    with pytest.raises(ValueError):
        similarity.set_similarity_pairs(df, "k", "e", 0.0)


@pytest.mark.parametrize(("block", "cells"), [(10**6, 10**6), (25, 40)])
def test_low_thresholds_are_counted_without_joining_pairs(spark, monkeypatch, block, cells):
    monkeypatch.setattr(similarity, "COUNT_BLOCK", block)
    monkeypatch.setattr(similarity, "CELLS", cells)
    sets = {i: {j for j in range(60) if (i * 7 + j * j) % (5 + i % 4) == 0} | {100} for i in range(40)}
    df = spark.createDataFrame([(k, e) for k, s in sets.items() for e in s], "k long, e long")
    found = similarity.set_similarity_pairs(df, "k", "e", 0.05)
    got = {(r["a"], r["b"]): r["similarity"] for r in found.collect()}
    sim = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    want = {(a, b): sim(a, b) for a in sets for b in sets if a < b and sim(a, b) >= 0.05}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_lineage(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "id string, parent string")
    got = {r["id"]: (r["root"], r["level"]) for r in lineage.lineage(df, "id", "parent").collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0)}


def test_split_needs_no_leak(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i // 3)) for i in range(20)], "id long, at timestamp")
    got = {r["id"]: r["split"] for r in windows.chronological_split(df, "at", "id").collect()}
    assert [got[i] for i in (0, 13, 14, 16, 17, 19)] == ["train", "train", "validation", "validation", "test", "test"]
    tiny = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id long, at timestamp")
    assert windows.chronological_split(tiny, "at", "id").first()["split"] == "train"


def test_split_shares_are_decimals(spark):
    df = spark.range(90).select("id", F.timestamp_seconds(F.col("id") * 60).alias("at"))  # 90 * 0.7 is 62.99... in floats
    assert {r["split"]: r["count"] for r in windows.chronological_split(df, "at", "id").groupBy("split").count().collect()}["train"] == 63


def test_train_statistics_ignore_test_rows(spark):
    rows = [(i, "train" if i < 6 else "test", float(i)) for i in range(9)]
    a = datamart.train_only_z(spark.createDataFrame(rows, "id long, split string, y double"), ["y"])
    b = datamart.train_only_z(spark.createDataFrame([(i, s, y + (100 if s == "test" else 0)) for i, s, y in rows], "id long, split string, y double"), ["y"])
    key = lambda df: {r["id"]: r["y_z"] for r in df.collect() if r["split"] == "train"}
    assert key(a) == key(b)


@pytest.mark.parametrize("salt_rows", [10000, 7])
def test_pairs_hold_the_best_earlier_rows_at_any_similarity(spark, salt_rows):
    sets = {i: ["all"] + [f"{i}x{j}" for j in range(20)] + [f"g{i % 3}y{j}" for j in range(i % 7)] for i in range(40)}
    rows = [(f"{i:02}", dt.datetime(2024, 1, 1 + i // 2), t, 1.0, 1.0, 1.0) for i, t in sets.items()]
    df = spark.createDataFrame(rows, "video_id string, as_of timestamp, tokens array<string>, y_reach_z double, y_engagement_z double, y_conversion_z double").withColumn("row_id", F.col("video_id"))
    df = df.select("*", *[F.lit(True).alias(f"{o}_available") for o in datamart.OBJECTIVES], *[F.lit(0.0).alias(f"{o}_{c}_z") for o in datamart.OBJECTIVES for c in datamart.COMPOSITE])
    got = {}
    for r in datamart.pair_rows(df, salt_rows=salt_rows).filter("objective = 'reach'").collect():
        got.setdefault(int(r["query_id"]), []).append((-r["similarity"], int(r["candidate_id"])))
    sim = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    want = {a: [(round(s, 6), b) for s, b in sorted((-round(sim(a, b), 9), b) for b in sets if b // 2 < a // 2)[:8]] for a in sets}
    assert {a: sorted(x) for a, x in got.items()} == {a: x for a, x in want.items() if x}


def _ranked(sets, k=8):
    """Brute force over id -> (at, tokens)."""
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    return {q: [(c, -s) for s, c in sorted((-round(sim(t, sets[c][1]), 9), c) for c in sets if sets[c][0] < at and set(t) & set(sets[c][1]))[:k]] for q, (at, t) in sets.items()}


@pytest.mark.parametrize(("known", "block", "threshold"), [(100_000, 10**6, 0.7), (8, 300, 0.7), (0, 40, 0.5), (8, 40, 1.0)])
def test_similar_sets_in_blocks_are_exact(spark, known, block, threshold):
    """Near copies, copies, sets of one element and empty ones, with blocks that cut even a single size into parts."""
    sets = {i: {(i // 6 * 53 + j * j) % 97 - 40 for j in range(5 + i // 6 % 9)} ^ {1000 + i % 3 * (i % 6 > 2)} for i in range(180)} | {200: {7}, 201: {7}, 202: {8}, 203: set(), 204: set()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "k long, s array<long>")
    got = sorted((r["a"], r["b"], round(r["similarity"], 9)) for r in similarity.similar_sets(df, "k", "s", threshold, known, block).collect())
    near = ((a, b, len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))) for a in sets for b in sets if a < b)
    want = sorted((a, b, round(s, 9)) for a, b, s in near if s >= threshold - 1e-12)
    assert got == want and len(want) > 100


@pytest.mark.parametrize(("block", "meetings"), [(10000, 100), (20, 3), (10000, 0)])
def test_nearest_earlier_rows_are_exact(spark, block, meetings):
    sets = {f"v{i}": (i * 37 % 50, sorted({f"a{i % 4}", f"b{i * i % 7}", f"c{i * 31 % 60}"} | ({"all"} if i % 3 else set()))) for i in range(150)}
    df = spark.createDataFrame([(i, at, t) for i, (at, t) in sets.items()], "id string, at long, tokens array<string>")
    got = {}
    for r in similarity.nearest_earlier(df, 8, block, meetings).collect():
        got.setdefault(r["q"], []).append((-round(r["similarity"], 9), r["c"]))
    want = {q: x for q, x in _ranked(sets).items() if x}
    assert {q: [(c, -s) for s, c in sorted(x)] for q, x in got.items()} == want


def test_trajectory_pairs_of_one_frequent_token(spark):
    """Hundreds of rows share all their tokens: only the smallest earlier ids stand out, and only objectives that are available are asked."""
    df = spark.range(400).select(F.lpad(((F.col("id") * 37) % 400).cast("string"), 3, "0").alias("video_id"), F.timestamp_seconds("id").alias("as_of"), F.array(F.lit("all")).alias("tokens")).withColumn("row_id", F.col("video_id"))
    df = df.select("*", *[F.lit(o != "reach").alias(f"{o}_available") for o in datamart.OBJECTIVES], *[F.lit(0.5).alias(f"{o}_{c}_z") for o in datamart.OBJECTIVES for c in (*datamart.COMPOSITE, "composite")])
    got = {}
    pairs = datamart.pair_rows(df, datamart.Config(target_source="trajectory_v2_composite"), salt_rows=50)
    for r in pairs.collect():
        got.setdefault((r["query_id"], r["objective"]), []).append(r["candidate_id"])
    want = {f"{i * 37 % 400:03}": sorted(f"{j * 37 % 400:03}" for j in range(i))[:8] for i in range(1, 400)}
    assert {k: sorted(x) for k, x in got.items()} == {(q, o): x for q, x in want.items() for o in ("engagement", "conversion")}


def test_rows_of_one_class_do_not_all_meet(spark):
    df = spark.range(3000).select(F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("string"), 7, "0").alias("id"), "id").toDF("id", "at")
    kept = similarity._undominated(df.select("id", "at", F.lit(1).alias("n"), F.array(F.lit(7).cast("long")).alias("f")), 8, 1000)
    assert 8 <= kept.count() < 500


def _no_pairs(monkeypatch):
    def asked(*a, **b):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(datamart, "pair_rows", asked)


def test_rows_make_no_pairs(spark, sf_dir, monkeypatch):
    from skein.queries import QUERIES

    _no_pairs(monkeypatch)
    assert QUERIES["datamart_rows"](spark, sf_dir).count() > 0
    with pytest.raises(ValueError):
        datamart.build({}, parts=["row"])


def test_availability_makes_no_pairs(spark, sf_dir, monkeypatch):
    from skein.queries import QUERIES

    _no_pairs(monkeypatch)
    assert QUERIES["datamart_availability"](spark, sf_dir).count() > 0


def test_exclusions_write_nothing(spark, sf_dir, monkeypatch):
    from skein.queries import QUERIES

    _no_pairs(monkeypatch)
    monkeypatch.setattr(datamart, "materialise", datamart.pair_rows)
    assert QUERIES["datamart_exclusions"](spark, sf_dir).count() > 0


def test_merge_best_keeps_keyless(spark):
    a = spark.createDataFrame([("k", 1, 0), (None, 5, 1)], "key string, score long, seq long")
    b = spark.createDataFrame([("k", 9, 2), (None, 5, 3)], "key string, score long, seq long")
    got = upsert.merge_best([a, b], "key", F.col("score"), F.col("seq")).collect()
    assert sorted((r["key"] or "", r["score"]) for r in got) == [("", 5), ("", 5), ("k", 9)]


def test_remap_drops_unmatched(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "video long, x string")
    assert [tuple(r) for r in upsert.remap_keys(rows, spark.createDataFrame([(1, 10)], "src long, dst long"), "video").collect()] == [(10, "a")]


def _samples(spark, **names):
    rows = [(k, s, float(x)) for k, both in names.items() for s, xs in enumerate(both) for x in xs]
    return spark.createDataFrame(rows, "name string, s int, x double")


def _policy(spark, n=50, base=0.01, now=0.01, author=0.0, language=0.0, locale=0.0):
    return spark.createDataFrame([(n, n, base, now, author, language, locale)], "baseline_n long, current_n long, baseline_fallback_rate double, fallback_rate double, author_cap_drop_rate double, strict_language_drop_rate double, strict_locale_drop_rate double")


def test_drift_measures(spark):
    a, b = [0.125, 0.25, 0.375], [1.0, 1.125, 1.375]  # exact in binary: 10 bins of 0.125
    got = stats.psi_by_name(_samples(spark, apart=(a, b), same=(a, a), flat=([1, 1], [1]), empty=(a, []))).collect()
    psi = {r["name"]: r["psi"] for r in got}
    edges = [(0.125 + i * 0.125, 0.25 + i * 0.125) for i in range(10)]  # ends count on both sides
    share = lambda xs, lo, hi: max(sum(lo <= x <= hi for x in xs) / 3, 1e-9)
    want = sum((share(b, *e) - share(a, *e)) * math.log(share(b, *e) / share(a, *e)) for e in edges)
    assert psi["same"] == psi["flat"] == psi["empty"] == 0 and math.isclose(psi["apart"], want, rel_tol=1e-6)
    ks = {r["name"]: r["ks"] for r in stats.ks_by_name(_samples(spark, apart=(a, b), same=(a, a), half=([1, 2], [2, 3]), empty=(a, []))).collect()}
    assert ks == {"apart": 1.0, "same": 0.0, "half": 0.5, "empty": 0.0}
    delta = {r["name"]: r["mean_delta"] for r in stats.mean_delta_by_name(_samples(spark, up=([2, 2], [3]), zero=([0], [0]), from_zero=([0], [4]), empty=([1], []))).collect()}
    assert delta == {"up": 0.5, "zero": 0.0, "from_zero": 1.0, "empty": 0.0}


def test_drift_summary(spark):
    far, near = ([0.1, 0.2, 0.3], [2.0, 2.1, 2.2]), ([0.1, 0.2, 0.3], [0.1, 0.2, 0.3])
    run = lambda f, policy, least=1, label=near: stats.drift_summary(_samples(spark, **f), _samples(spark, primary_24h=label), policy, least).first().asDict()
    r = run({"mandatory_score": far}, _policy(spark, 30, 0.01, 0.10), label=far)
    assert r["feature_mandatory"] and r["label"] and r["policy"] and (r["severity"], r["recommendation"]) == ("critical", "retrain_candidate")
    r = run({"mandatory_score": far}, _policy(spark, 1, 0.01, 0.8), 10, far)
    assert not r["policy"] and not r["sufficient"] and r["severity"] == r["recommendation"] == "insufficient_data"
    r = run({"mandatory_score": near}, _policy(spark, language=0.35))
    assert r["policy"] and not r["feature_mandatory"] and not r["label"] and r["severity"] == "critical"
    r = run({"optional_score": far, "mandatory_score": near}, _policy(spark))
    assert r["feature_optional"] and (r["severity"], r["recommendation"]) == ("warning", "monitor")
    r = run({"other_score": far, "mandatory_score": near}, _policy(spark, now=0.03, base=0.01))
    assert not r["policy"] and (r["severity"], r["recommendation"]) == ("ok", "none")  # 0.02 more is not above 0.02


def test_running_sums_are_those_of_one_window(spark):
    rows = [(i % 3, (i * 37) % 50, float(i)) for i in range(400)] + [(0, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, t int, v double").withColumn("i", F.monotonically_increasing_id())
    got = windows.running_before(df, "t", {"total": ("sum", "v"), "top": ("max", "v")}, ["k"], ["i"], ranges=7)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("total", F.coalesce(F.sum("v").over(w), F.lit(0.0))).withColumn("top", F.max("v").over(w))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    plan = windows.chronological_split(df, "t", "i")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("_before")[0] or "Window" in plan


def test_asof_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(m))
    left = [(i, int(rng.integers(0, 4)), at(rng.integers(0, 9000))) for i in range(120)] + [(500, None, at(5)), (501, 1, None)]
    right = [(int(rng.integers(0, 4)), at(rng.integers(0, 900) * 10), int(rng.integers(0, 5)), i) for i in range(150)] + [(None, at(4), 1, 900), (1, None, 1, 901)]
    lf, rf = spark.createDataFrame(left, "row_id int, k int, t timestamp"), spark.createDataFrame(right, "k2 int, e timestamp, tie int, v int")
    for direction, tolerance in (("backward", None), ("forward", None), ("backward", "90 MINUTES"), ("forward", "90 MINUTES")):
        got = {r["row_id"]: r["v"] for r in asof.asof_join(lf, rf, [("k", "k2")], F.col("t"), "e", "tie", ["v", "tie"], direction, tolerance=tolerance).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            ok = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] <= t if direction == "backward" else r[1] >= t) and (tolerance is None or abs(r[1] - t) <= dt.timedelta(minutes=90))]
            best = (max if direction == "backward" else min)(ok, key=lambda r: (r[1], r[2]), default=None)
            same = [r[3] for r in ok if best and r[1:3] == best[1:3]] or [None]
            assert got[i] in same, (direction, i)


def test_outcome_reasons(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    df = spark.createDataFrame([(t(0), t(5)), (t(0), None), (t(0), t(60)), (t(40), t(41))], "served timestamp, ingested timestamp")
    got = [r[0] for r in df.select(asof.classify_outcome(F.col("served"), 24, F.lit("2024-01-03").cast("timestamp"), F.col("ingested"))).collect()]
    assert got == [None, "missing_snapshot", "ingested_after_cutoff", "not_matured_24h"]


def test_feedback_states_and_profile(spark):
    s, r, n, w = "comparable_saved", "comparable_marked_relevant", "comparable_marked_not_relevant", "comparable_opened"
    rows = [(1, "a", s), (1, "a", r), (1, "b", r), (1, "c", n), (1, "d", w), (1, "e", "other"), (1, "f", s), (1, "f", n)]
    e = spark.createDataFrame([(*x, dt.datetime(2024, 1, 1)) for x in rows], "owner int, item string, kind string, at timestamp")
    got = {x["item"]: (x["state"], x["priority"]) for x in experiments.resolve_feedback(e, ["item"], "kind").collect()}
    assert got == {"a": ("saved", 3), "b": ("relevant", 2), "c": ("not_relevant", 0), "d": ("weak_positive", 1), "e": ("unlabeled", 1), "f": ("conflict", -1)}
    feats = spark.createDataFrame([(i, f, t) for i in "abcdef" for f, t in (("topic", "x"), ("author", i))], "item string, field string, token string")
    prof = experiments.preference_profile(e, "owner", "item", "kind", "at", F.lit("2024-02-15").cast("timestamp"), feats)
    got = {(x["polarity"], x["field"], x["token"]): round(x["weight"], 6) for x in prof.collect()}
    assert got == {("positive", "topic", "x"): 1.125, ("negative", "topic", "x"): 0.5, ("positive", "author", "a"): 0.3125, ("positive", "author", "b"): 0.25, ("negative", "author", "c"): 0.25}


def test_retrain_reasons(spark):
    def run(severities, advice=None, scheduled=False):
        rows = [(i, s, a) for i, (s, a) in enumerate(zip(severities, advice or [""] * len(severities), strict=True))]
        return experiments.retrain_trigger(spark.createDataFrame(rows, "t int, severity string, advice string"), "t", "severity", "advice" if advice else None, 2, scheduled).first()["reason"]

    assert run(["ok", "Critical ", "critical"]) == "drift_trigger" and run(["critical", "ok"]) == "no_trigger" and run(["critical", "ok"], scheduled=True) == "scheduled_weekly"
    assert run(["critical", "critical"], ["retrain_candidate", "monitor"]) == "no_trigger" and run(["critical", "critical"], ["retrain_candidate", "RETRAIN_candidate"]) == "drift_trigger"


def test_affinity(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 3.0}, {"c": 2.0}, ["a", "c", "a"], "b")], "p map<string,double>, n map<string,double>, t array<string>, v string")
    p, n = F.col("p"), F.col("n")
    got = df.select(ranking.token_affinity(F.col("t"), p, n), ranking.token_affinity(F.array().cast("array<string>"), p, n), ranking.value_affinity(F.col("v"), p, n), ranking.value_affinity(F.lit(""), p, n)).first()
    assert tuple(got) == (0.5 + (0.25 - 1.0) * 0.5, 0.5, 0.5 + 0.75 * 0.5, 0.5)
    parts = {"topic": F.lit(1.0), "hashtags": F.lit(0.5), "content_type": F.lit(0.0), "author": F.lit(1.0)}
    got = df.select(ranking.affinity(parts), ranking.affinity_confidence(F.lit(12), F.lit(6), F.lit(4), F.lit(18.0), F.lit(True)), ranking.blend_affinity(F.lit(0.5), F.lit(0.59), F.lit(1.0), F.lit(0.5)), ranking.blend_affinity(F.lit(0.5), F.lit(0.9), F.lit(1.0), F.lit(0.01))).first()
    assert np.allclose(list(got), [0.66, 0.75 * 0.45 + 0.5 * 0.2 + 0.5 * 0.2 + 0.9 * 0.15, 0.5 + 0.08 * 0.5 * 0.5, 0.5])


def test_regimes_and_sizes(spark):
    rows = spark.createDataFrame([(2.0, -0.5, 0.0, -0.1), (0.1, 2.0, 1.2, -0.1), (0.5, 0.5, 0.5, -0.1)], "early double, late double, ratio double, stability double")
    logits = scalars.regime_logits("early", "late", "ratio", "stability")
    got = [tuple(round(x, 6) for x in r) for r in rows.select(*logits).collect()]
    assert got == [(1.4 * 2 + 0.4 + 0.245, 0.05, 0.0), (0.14, 0.05, 3.68), (0.7, 1.0, 1.1)]
    sizes = [r[0] for r in spark.createDataFrame([(x,) for x in (None, 9_999, 10_000, 100_000, 1_000_000)], "n long").select(scalars.follower_bucket("n")).collect()]
    assert sizes == ["nano", "nano", "micro", "macro", "mega"]


def test_negative_relevance_counts_as_none(spark):
    df = spark.createDataFrame([("q", 1, 3.0, -2), ("q", 2, 2.0, 1), ("q", 3, 1.0, 0)], "q string, item int, score double, rel int")
    r = evaluation.ranking_metrics(df, "q", "score", "rel", "item", 3).first()
    assert math.isclose(r["ndcg"], 1 / math.log2(3), abs_tol=1e-6) and r["mrr"] == 0.5


def test_char_terms(spark):
    got = spark.createDataFrame([(["ab", "xyz"],)], "w array<string>").select(tags.char_terms(F.col("w"))).first()[0]
    assert sorted(got) == sorted([" ab", "ab ", " ab ", " xy", "xyz", "yz ", " xyz", "xyz ", " xyz "])


def test_gate(spark):
    m = spark.createDataFrame([(0.5, 10.0), (0.9, 30.0), (None, 1.0)], "ndcg double, p95 double")
    got = [r["failed"] for r in experiments.promotion_gate(m, {"ndcg": (">=", 0.4), "p95": ("<=", 25)}).collect()]
    assert got == [[], ["p95"], ["ndcg"]]


def test_policy_rerank_caps_authors(spark):
    rows = [("q", f"i{i}", 1.0 - i / 100, "a" if i < 5 else f"b{i}", "t", 1.0, False) for i in range(8)] + [("q", "old", 9.0, "z", "t", 1e6, True)]
    df = spark.createDataFrame(rows, "query string, item string, score double, author string, topic string, age_hours double, locale_match boolean")
    got = [r["item"] for r in retrieval.policy_rerank(df, retrieval.Policy(top_k=4)).orderBy("rank").collect()]
    assert got[0] == "i0" and "old" not in got and len([i for i in got if i in ("i0", "i1", "i2", "i3", "i4")]) == 2


def test_exact_topk_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "id long, v array<double>")
    q = df.filter("id % 10 = 0")
    whole = sorted(map(tuple, retrieval.exact_topk(df, q, "id", "id", "v", 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    assert sorted(map(tuple, retrieval.exact_topk(df, q, "id", "id", "v", 4).collect())) == whole


def test_walks_repeat_and_stay_on_edges(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double")
    once = sorted(tuple(r["walk"]) for r in graph.random_walks(e, 3, 4).collect())
    assert once == sorted(tuple(r["walk"]) for r in graph.random_walks(e, 3, 4).collect())
    assert all({x, y} in ({"a", "b"}, {"b", "c"}) for w in once for x, y in zip(w, w[1:], strict=False))


def test_walks_draw_from_all_edges_by_weight(spark):
    e = spark.createDataFrame([("hub", f"n{i}", 1.0 + (i % 2) * 2) for i in range(200)], "src string, dst string, weight double")
    walks = [r["walk"] for r in graph.random_walks(e).collect()]
    steps = [y for w in walks for x, y in zip(w, w[1:], strict=False) if x == "hub"]
    assert len(walks) == 201 * 20 and all(len(w) == 12 for w in walks) and len(set(steps)) == 200
    assert abs(sum(int(y[1:]) % 2 for y in steps) / len(steps) - 0.75) < 0.02
    assert all({x, y} & {"hub"} and x != y for w in walks for x, y in zip(w, w[1:], strict=False))


def test_node_vectors_are_the_svd_of_the_co_occurrence(spark, monkeypatch):
    """Of the walks themselves, as the reference has it; hot nodes in pieces and columns in groups change nothing."""
    e = spark.createDataFrame([(f"n{i}", f"t{j}", 1.0 + (i * j) % 5) for i in range(14) for j in range(6) if (i + j) % 3], "src string, dst string, weight double")
    m = {}
    for r in graph.random_walks(e, 5, 7, 3).collect():
        for i, x in enumerate(r["walk"]):
            for y in r["walk"][max(0, i - 2) : i] + r["walk"][i + 1 : i + 3]:
                m[x, y] = m.get((x, y), 0) + 1
    names = sorted({x for x, _ in m})
    c = np.array([[m.get((x, y), 0) for y in names] for x in names], float)
    u, s, _ = np.linalg.svd(c / c.sum(1, keepdims=True))
    want = u[:, :12] * s[:12]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    for cells, block in ((walks.CELLS, walks.ROW_BLOCK), (220, 8)):
        monkeypatch.setattr(walks, "CELLS", cells)
        monkeypatch.setattr(walks, "ROW_BLOCK", block)
        got = {r["id"]: r["vector"] for r in graph.node_vectors(e, 5, 7, 12, 2, 3).collect()}
        got = np.array([got[x] for x in names])
        assert len(names) == 20 and np.abs(got @ got.T - want @ want.T).max() < 1e-4


def test_walks_of_hot_nodes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(walks, "PIECE", 30)
    monkeypatch.setattr(walks, "EDGE_BLOCK", 50)
    monkeypatch.setattr(walks, "FLUSH", 500)
    monkeypatch.setattr(walks, "WALK_BLOCK", 300)
    e = spark.createDataFrame([("hub", f"n{i}", 1.0 + (i % 2) * 2) for i in range(200)], "src string, dst string, weight double")
    rows = graph.random_walks(e).collect()
    steps = [y for r in rows for x, y in zip(r["walk"], r["walk"][1:], strict=False) if x == "hub"]
    assert len({(r["start"], r["no"]) for r in rows}) == len(rows) == 201 * 20 and all(r["walk"][0] == r["start"] and len(r["walk"]) == 12 for r in rows)
    assert len(set(steps)) == 200 and abs(sum(int(y[1:]) % 2 for y in steps) / len(steps) - 0.75) < 0.02
    assert all({x, y} & {"hub"} and x != y for r in rows for x, y in zip(r["walk"], r["walk"][1:], strict=False))


def test_node2vec_has_the_whole_size(spark, sf_dir):
    from skein.queries import QUERIES

    rows = QUERIES["node2vec_embeddings"](spark, sf_dir).collect()
    assert rows and all(len(r["vector"].split(",")) == 32 for r in rows)


def test_fabric(spark):
    schema = "caption string, transcript_text string, ocr_text string, hashtags array<string>, keywords array<string>, duration_seconds int, content_type string, hints map<string,string>, as_of_time timestamp, source_updated_at timestamp"
    t = dt.datetime(2024, 1, 2)
    rows = [("follow me now", None, None, ["#x"], None, 30, "story", {"audio_energy": "0.7", "video_caption": "a cat"}, t, t - dt.timedelta(hours=5)), ("", None, None, None, None, None, None, {"estimated_scene_cuts": "24", "speech_seconds": "0"}, t, None)]
    df = spark.createDataFrame(rows, schema)
    r, q = fabric.extract(df).collect()
    assert r["text_features"]["cta_keyword_count"] == 1 and r["text_features"]["missing"]["transcript_text"].asDict() == {"reason": "not_available", "source_age_hours": 5.0}
    assert r["text_features"]["confidence"] == round(0.70 * 0.94 + 0.03, 6) and q["text_features"]["missing"]["caption"].asDict() == {"reason": "low_quality", "source_age_hours": None}
    x = r["structure_features"]
    assert (x["hook_window_end_sec"], x["payoff_window_start_sec"], x["hook_timing_seconds"], x["payoff_timing_seconds"], x["mid_window_end_sec"], x["payoff_window_end_sec"]) == (4.2, 24.9, 4.2, 24.9, 24.4, 30.0)
    assert r["audio_features"].asDict(True) == {"speech_ratio": 0.55, "tempo_bpm": 108.0, "energy": 0.7, "music_presence_score": 0.65, "confidence": round(0.76 * 0.9 + 0.05, 6), "missing": {}}
    assert r["visual_features"]["shot_change_rate"] is None and set(r["visual_features"]["missing"]) == {"shot_change_rate", "visual_motion_score"} and r["visual_features"]["confidence"] == 0.32
    assert q["visual_features"].asDict() | {"missing": 0} == {"shot_change_rate": 0.8, "visual_motion_score": round(0.8 / 1.8, 6), "style_tags": ["rapid_cut"], "confidence": round(0.78 * 0.9 + 0.05, 6), "missing": 0}
    assert {x["feature"] for x in fabric.missing_by_reason(fabric.extract(df)).collect()} >= {"ocr_text", "content_type"}


def test_contracts_and_bundle(spark, tmp_path):
    raw = jsonl.synthetic_posts(spark, 60).withColumn("line", F.col("id").cast("long"))
    b = contracts.normalise_records(raw, "2024-06-01T00:00:00Z")
    b["authors"] = contracts.merge_latest(b["authors"], "author_id", "seen_at", "line", ["username"], largest=["followers"])
    assert contracts.validate_bundle(b, "2024-06-01T00:00:00Z").count() == 0
    assert contracts.validate_bundle({**b, "authors": b["authors"].limit(0)}, "2024-06-01T00:00:00Z").filter("reason = 'missing_author_id'").count() > 0
    folder = manifest.write_bundle({"videos": b["videos"].drop("quality_reasons")}, str(tmp_path), "v1")
    assert manifest.write_bundle({"videos": b["videos"].drop("quality_reasons")}, str(tmp_path), "v1") == folder
    assert manifest.read_bundle(spark, folder)["videos"].count() == 60
    spark.range(1).selectExpr("'x' as video_id").write.mode("append").parquet(f"{folder}/videos/source=src0")
    with pytest.raises(ValueError):
        manifest.read_bundle(spark, folder)
    with pytest.raises(ValueError):
        contracts.guard_track(raw, "pre_publication")
    assert contracts.validate_posts(raw, "2030-01-01").filter("size(errors) > 0").count() == 0


def test_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"id": "1", "views": 3}\n\n{"id": \n{"id": "2"}\n')
    good, bad = jsonl.read_tolerant(spark, str(f))
    assert sorted((r["id"], r["line"]) for r in good.collect()) == [("1", 1), ("2", 4)]
    assert [r["line"] for r in bad.collect()] == [3]
    extracts.export(good.select("id", "hashtags"), str(tmp_path / "out"), "csv")
    assert extracts.read_snapshot(spark, str(tmp_path / "out"), "csv").count() == 2
    with pytest.raises(ValueError):
        extracts.keyset_page(good, "line", "id", 0)


def test_medallion(spark):
    raw = jsonl.synthetic_posts(spark, 20).withColumn("line", F.col("id").cast("long"))
    twice = raw.unionByName(raw.withColumn("line", F.col("line") + 100).withColumn("views", F.lit(7).cast("long")))
    v = medallion.silver_full(twice)
    assert v.count() == 20 and v.select("views").distinct().first()["views"] == 7 and v.first()["n_comments"] == 3


def test_datamart_build(spark):
    raw = jsonl.synthetic_posts(spark, 40).withColumn("line", F.col("id").cast("long"))
    later = raw.withColumn("scraped_at", F.date_format(F.to_timestamp("posted_at") + F.expr("INTERVAL 100 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    first = raw.withColumn("scraped_at", F.col("posted_at"))
    b = contracts.normalise_records(first.unionByName(later.withColumn("line", F.col("line") + 1000)), "2024-06-01T00:00:00Z")
    b["videos"] = b["videos"].dropDuplicates(["video_id"])
    out = datamart.build(b)
    assert out["rows"].count() == 40 and {r["reason"]: r["n"] for r in out["stats"].collect()} == {"included": 40}
    pairs = out["pairs"]
    assert pairs.count() > 0 and pairs.groupBy("query_id", "objective").count().filter("count > 8").count() == 0
    with pytest.raises(ValueError):
        datamart.Config(train=0.9, validation=0.2)


def test_trajectory_masks_and_reasons(spark):
    t0 = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    hour = lambda h: t0 + day + dt.timedelta(hours=h)
    videos = spark.createDataFrame([(v, "a", "step by step", ["#X"], t0) for v in "abcdef"], "video_id string, author_id string, caption string, hashtags array<string>, posted_at timestamp")
    late, ok = "late_out_of_watermark", "on_time"
    rows = [("a", hour(h), hour(h), ok, n) for h, n in ((-1, 9), (5, 99), (23, 999), (95, 9999))]  # all four boundaries
    rows += [("b", hour(4), hour(4), ok, 10), ("b", hour(80), hour(80), ok, 20)]  # nothing at the anchor
    rows += [("c", hour(-2), hour(-2), late, 5), ("c", hour(75), hour(75), ok, 5)]  # late at the anchor
    rows += [("d", hour(-2), hour(900), ok, 5), ("d", hour(75), hour(75), ok, 5)]  # known only after the run
    rows += [("e", hour(-2), hour(-2), ok, 5)]  # no future snapshot
    s = spark.createDataFrame([(f"s{i}", *r, 0, 0, 0) for i, r in enumerate(rows)], "video_snapshot_id string, video_id string, event_time timestamp, ingested_at timestamp, lateness string, views long, likes long, comments_count long, shares long")
    authors = spark.createDataFrame([("a", 50_000)], "author_id string, followers long")
    got = {r["video_id"]: r for r in datamart.point_in_time_rows({"videos": videos, "video_snapshots": s, "authors": authors}, datamart.Config(run_at="2024-01-20")).collect()}
    a = got["a"]
    logs = [math.log(10), math.log(100), math.log(1000), math.log(10000)]
    assert a["exclusion_reason"] is None and a["reach_available"] and a["reach_reasons"] == [] and a["author_size"] == "micro" and a["content_type"] == "tutorial"
    v = [(logs[1] - logs[0]) / 6, (logs[2] - logs[1]) / 18, (logs[3] - logs[2]) / 72]
    assert np.allclose([a["reach_early_velocity"], a["reach_core_velocity"], a["reach_late_lift"], a["reach_stability"]], [v[0], v[1], logs[3] - logs[2], -np.std(v, ddof=1)], atol=2e-6)
    assert a["tr_peak_lag_hours"] == 96 and a["tr_available_ratio"] == 1 and a["tr_missing_component_count"] == 0 and math.isclose(a["tr_late_velocity"], (logs[3] - logs[2]) / 3 / 72, abs_tol=2e-6)
    assert math.isclose(a["regime_spike"] + a["regime_balanced"] + a["regime_durable"], 1, abs_tol=2e-6)
    assert got["b"]["reach_reasons"] == ["missing_anchor_snapshot"] and not got["b"]["reach_available"] and "missing_pre_snapshot" in got["b"]["missingness_flags"] and got["b"]["reach_core_velocity"] is not None
    assert "late_out_of_watermark" in got["c"]["reason_t0"] and got["d"]["reason_t0"] == "ingested_after_cutoff"
    assert got["e"]["exclusion_reason"] == got["f"]["exclusion_reason"] == "missing_future_snapshot" and got["f"]["reason_t0"] == "missing_anchor_snapshot"
    early = datamart.point_in_time_rows({"videos": videos, "video_snapshots": s, "authors": authors}, datamart.Config(run_at="2024-01-03")).select("exclusion_reason").distinct().collect()
    assert [r[0] for r in early] == ["label_horizon_not_available"]


def test_comment_intelligence_ladder(spark):
    t = dt.datetime(2024, 1, 5)
    rows = spark.createDataFrame([("a", t, "x", "story", "nano", ["f"]), ("b", t, "y", "story", "nano", [])], "video_id string, as_of timestamp, topic_key string, content_type string, author_size string, missingness_flags array<string>")
    feats = spark.createDataFrame([("a", t, *[0.5] * 6), ("a", t + dt.timedelta(hours=1), *[0.9] * 6)], "video_id string, as_of_time timestamp, " + ", ".join(f"{c} double" for c in datamart.COMMENT))
    priors = spark.createDataFrame([("y", "story", "nano", 0.25)], "topic_key string, content_type string, author_size string, alignment_score double")
    post = {r["video_id"]: r for r in datamart.comment_intelligence(rows, {"comment_features": feats}, datamart.Config(track="post_publication")).collect()}
    assert (post["a"]["comment_source"], post["a"]["alignment_score"], post["b"]["comment_source"], post["b"]["alignment_score"]) == ("video_snapshot", 0.5, "missing", 0.0)
    assert post["b"]["missingness_flags"] == ["comment_intelligence:missing_comment_snapshot_manifest_row"] and post["a"]["missingness_flags"] == ["f"]
    pre = {r["video_id"]: r for r in datamart.comment_intelligence(rows, {"comment_priors": priors}, datamart.Config()).collect()}
    assert (pre["b"]["comment_source"], pre["b"]["alignment_score"], pre["a"]["comment_source"]) == ("transfer_prior", 0.25, "missing")


@pytest.mark.parametrize(("n", "want"), [(1, [1, 0, 0]), (2, [1, 0, 1]), (3, [1, 1, 1]), (10, [7, 1, 2]), (40, [28, 6, 6])])
def test_split_sizes(spark, n, want):
    s = windows.chronological_split(spark.range(n).withColumn("t", F.col("id") * 2), "t", "id")
    got = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert [got.get(x, 0) for x in ("train", "validation", "test")] == want
