"""Candidate preparation, query profiles, benchmarks and comment snapshots over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import benchmark as B
from skein.operators import candidates as C
from skein.operators import comments as M
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s#@-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _topic(tokens: str, first_tag: str) -> str:
    cases = " ".join(f"WHEN len(list_intersect({tokens}, {terms!r})) > 0 THEN '{name}'" for name, terms in C.TOPICS.items())
    return f"CASE {cases} ELSE coalesce({first_tag}, 'general') END"


def _objective(text: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({text}, '{t}')" for t in terms) + f" THEN '{name}'" for name, terms in C.OBJECTIVE_TERMS.items())
    return f"CASE {cases} ELSE 'reach' END"


_RAW = f"""c AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE upper(source) END AS author, CASE WHEN doc_id % 17 = 0 THEN '' ELSE "text" END AS text, CASE doc_id % 3 WHEN 0 THEN ['travel'] WHEN 1 THEN ['tag' || (doc_id % 5)] ELSE [] END AS tags,
CASE WHEN doc_id % 4 = 0 THEN ['viral save', lang] ELSE [] END AS keys, CASE doc_id % 3 WHEN 0 THEN 'story' WHEN 1 THEN 'other' ELSE 'behind_the_scenes' END AS kind, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang0, CASE WHEN doc_id % 2 = 0 THEN lang || '-xx' END AS place,
CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' - to_days((doc_id % 60)::INT) END AS posted, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS views, doc_id % 7 = 0 AS hc, doc_id % 9 = 0 AS ht FROM documents),
n AS (SELECT *, coalesce({_norm("text")}, '') AS clean, coalesce(lang0, split_part(place, '-', 1)) AS lang FROM c),
t AS (SELECT *, list_distinct(list_concat(list_filter(string_split(clean, ' '), lambda w: w <> ''), keys)) AS tokens FROM n),
p AS (SELECT *, {_topic("list_concat(tokens, tags)", "tags[1]")} AS topic, (author = '' OR (clean = '' AND len(tags) = 0 AND len(keys) = 0)) AS fails, views <= 0 AND NOT ht AS cold FROM t),
s AS (SELECT *, CASE WHEN fails THEN 0 ELSE round(0.12 + (clean <> '')::INT * 0.28 + (len(tags) > 0)::INT * 0.10 + (len(keys) > 0)::INT * 0.06 + (topic <> 'general')::INT * 0.05 + (posted IS NOT NULL)::INT * 0.05 + hc::INT * 0.10 + (lang IS NOT NULL)::INT * 0.08 + (place IS NOT NULL)::INT * 0.08 + (kind <> 'other')::INT * 0.08, 4) END AS score,
least(1, (clean <> '')::INT * 0.35 + least(len(tags), 5) * 0.05 + least(len(keys), 5) * 0.04) AS semantic, CASE WHEN posted IS NULL THEN 0.5 WHEN doc_id % 60 + 9 <= 2 THEN 0.85 WHEN doc_id % 60 + 9 <= 14 THEN 0.65 WHEN doc_id % 60 + 9 <= 45 THEN 0.45 ELSE 0.3 END AS fresh FROM p),
f AS (SELECT *, least(1, semantic * 0.45 + CASE WHEN topic <> 'general' THEN 0.65 ELSE 0.35 END * 0.25 + fresh * 0.2 + cold::INT * 0.18) AS fb FROM s)"""


def _candidates(spark, d):
    i, none = F.col("doc_id"), F.array().cast("array<string>")
    return table(spark, d, "documents").select(
        i.alias("candidate_id"), F.when(i % 13 == 0, " ").otherwise(F.upper("source")).alias("author_id"), F.when(i % 17 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(i % 3 == 0, F.array(F.lit("#Travel"), F.lit(" travel"))).when(i % 3 == 1, F.array(F.concat(F.lit("Tag"), (i % 5).cast("string")))).otherwise(none).alias("hashtags"),
        F.when(i % 4 == 0, F.array(F.lit("Viral, save!"), F.col("lang"), F.lit(" "))).otherwise(none).alias("keywords"), F.lit(None).cast("string").alias("topic_key"),
        F.when(i % 3 == 0, "Story ").when(i % 3 == 1, "unknown kind").otherwise("Behind the scenes").alias("content_type"), F.when(i % 5 != 0, F.upper("lang")).alias("language"),
        F.when(i % 2 == 0, F.concat(F.col("lang"), F.lit("_XX"))).alias("locale"), F.when(i % 11 != 0, F.lit("2024-01-01").cast("timestamp") - F.make_dt_interval(days=(i % 60).cast("int"))).alias("posted_at"),
        F.when(i % 2 == 0, F.col("n_chars")).otherwise(F.lit(0)).alias("views"), F.lit(0).alias("likes"), F.lit(None).cast("int").alias("comments"), F.lit(0).alias("shares"), (i % 7 == 0).alias("has_comments"), (i % 9 == 0).alias("has_trajectory"),
    )


@PLANS.add(f"""WITH {_RAW} SELECT doc_id AS candidate_id, CASE WHEN author = '' THEN 'unknown' ELSE lower(author) END AS author_id, topic AS topic_key, len(tokens) AS n_tokens, kind AS content_type, {_objective("clean || ' ' || array_to_string(tags, ' ') || ' ' || array_to_string(keys, ' ')")} AS objective_guess,
lang AS language, place AS locale, score::DOUBLE AS support_score, CASE WHEN score >= 0.75 THEN 'full' WHEN score >= 0.45 THEN 'partial' ELSE 'low' END AS support_level, cold AS is_cold_start, round(semantic, 6)::DOUBLE AS semantic_signal, round(fb, 6)::DOUBLE AS fallback_rank_signal, round(greatest(0.15, least(0.95, 1 - fb)), 6)::DOUBLE AS uncertainty,
(author = '')::INT + (clean = '' AND len(tags) = 0 AND len(keys) = 0)::INT + cold::INT + CASE WHEN fails THEN 0 ELSE (clean = '')::INT + (len(tags) = 0)::INT + (len(keys) = 0)::INT + (topic = 'general')::INT + (posted IS NULL)::INT + (NOT hc)::INT + (lang IS NULL)::INT + (place IS NULL)::INT + (kind = 'other')::INT END AS n_flags FROM f""")
def candidate_preparation(spark, d):
    """Documents as candidates: topic, objective, support and the cold-start fallback."""
    c = C.prepare(_candidates(spark, d), "2024-01-10")
    return c.select("candidate_id", "author_id", "topic_key", F.size("tokens").cast("long").alias("n_tokens"), "content_type", "objective_guess", "language", "locale", "support_score", "support_level", "is_cold_start", "semantic_signal", "fallback_rank_signal", "uncertainty", F.size("support_flags").cast("long").alias("n_flags"))


@PLANS.add(f"""WITH q AS (SELECT conv_id || ':' || turn AS query_id, turn, coalesce({_norm('"text"')}, '') AS clean FROM conversations), t AS (SELECT *, list_distinct(list_concat(list_filter(string_split(clean, ' '), lambda w: w <> ''), CASE WHEN turn % 2 = 0 THEN ['gym tips'] ELSE [] END)) AS tokens, CASE WHEN turn % 3 = 0 THEN ['meme'] ELSE [] END AS tags FROM q)
SELECT query_id, clean AS query_text, len(tokens) AS n_tokens, len(list_distinct(list_concat(tokens, tags))) AS n_lexical, CASE WHEN turn % 4 = 3 THEN 'given' ELSE {_topic("list_concat(tokens, tags)", "tags[1]")} END AS topic_key, CASE turn % 2 WHEN 0 THEN 'link_click' ELSE 'none' END AS primary_cta, 'reaction' AS content_type, CASE turn % 2 WHEN 0 THEN 'pt' ELSE 'en' END AS language, CASE turn % 2 WHEN 0 THEN 'pt-br' END AS locale FROM t""")
def query_profiles(spark, d):
    even, none = F.col("turn") % 2 == 0, F.array().cast("array<string>")
    q = table(spark, d, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), "text", F.when(F.col("turn") % 3 == 0, F.array(F.lit("#MEME"))).otherwise(none).alias("hashtags"), F.when(even, F.array(F.lit("Gym tips"))).otherwise(none).alias("keywords"),
        F.when(F.col("turn") % 4 == 3, " Given ").alias("topic_key"), F.lit("Reaction").alias("content_type"), F.when(even, "Link click").otherwise("call").alias("primary_cta"), F.when(~even, "EN").alias("language"), F.when(even, "pt_BR").alias("locale"),
    )
    n = lambda c: F.size(c).cast("long")
    return C.query_profiles(q).select("query_id", "query_text", n("tokens").alias("n_tokens"), n("lexical_tokens").alias("n_lexical"), "topic_key", "primary_cta", "content_type", "language", "locale")


@PLANS.add("""SELECT d.doc_id, CASE WHEN quality = 1 THEN 'own' ELSE lang END AS lang, coalesce(toxic, n_chars) AS n_chars, CASE WHEN quality = 0 THEN 'q' ELSE source END AS tag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def payload_merge(spark, d):
    """Labels as the request's own values: blank text and empty lists do not replace."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.array("source").alias("tags"))
    own = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "own").otherwise(" ").alias("lang"), F.col("toxic").cast("long").alias("n_chars"), F.when(F.col("quality") == 0, F.array(F.lit("q"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return C.merge_payloads(docs, own, "doc_id").select("doc_id", "lang", "n_chars", F.get("tags", F.lit(0)).alias("tag"))


@PLANS.add("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 2 = 0 THEN (o_orderkey % 5)::DOUBLE ELSE o_totalprice END DESC, o_totalprice DESC, o_orderkey % 3 DESC, o_orderkey) AS position FROM orders""")
def composite_order(spark, d):
    o = table(spark, d, "orders").withColumn("portfolio", (F.col("o_orderkey") % 5).cast("double")).withColumn("fused", F.col("o_orderkey") % 3)
    return C.final_order(o, "o_custkey", "portfolio", "o_totalprice", "fused", "o_orderkey", F.col("o_custkey") % 2 == 0).select("o_orderkey", "position")


@PLANS.add("""WITH k AS (SELECT user_id, event_type, (props->>'$.k')::INT AS k, min(event_id) AS first FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY ALL), p AS (SELECT user_id, k, min(CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END) AS side, arg_min(first, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END) AS first FROM k GROUP BY ALL)
SELECT user_id, string_agg(k::VARCHAR, ',' ORDER BY side, first) AS memory, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY side, first) AS r FROM p) WHERE r <= 24 GROUP BY user_id""")
def candidate_memory(spark, d):
    """Items of a user's purchases in order, then of sign-ups, 24 at most."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("event_id", "k")))), lambda x: x["k"])
    u = e.groupBy("user_id").agg(listed("purchase").alias("a"), listed("signup").alias("b"))
    m = C.merge_memory(F.col("a"), F.col("b"))
    return u.select("user_id", F.array_join(m, ",").alias("memory"), F.size(m).cast("long").alias("n")).filter("n > 0")


_REWARD = ", ".join(f"greatest(0, least(1, {' + '.join(f'{w} * {k}' for k, w in ws.items())})) AS {a}" for a, ws in C.REWARDS.items())


@PLANS.add(f"""WITH s AS (SELECT user_id, least(ln(1 + sum(value)) / ln(1 + 1e7), 1) AS views, least((count(*) FILTER (WHERE event_type = 'click') / count(*)) / 0.1, 1) AS er, (user_id % 5) / 10.0 AS spike, (user_id % 3) / 10.0 AS balanced, 0.3 AS durable FROM events GROUP BY user_id), r AS (SELECT user_id, {_REWARD} FROM s)
SELECT user_id, round(reach, 6) AS reach, round(retention, 6) AS retention, CASE greatest(reach, engagement, conversion, retention) WHEN reach THEN 'reach' WHEN engagement THEN 'engagement' WHEN conversion THEN 'conversion' ELSE 'retention' END AS action FROM r""")
def reward_actions(spark, d):
    """Rewards of content strategies and the one that pays best."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("v"), (F.count_if(F.col("event_type") == "click") / F.count("*")).alias("er"))
    regimes = {"spike": (F.col("user_id") % 5) / 10.0, "balanced": (F.col("user_id") % 3) / 10.0, "durable": F.lit(0.3)}
    args = (F.col("v"), F.col("er"), regimes)
    return u.select("user_id", F.round(C.reward("reach", *args), 6).alias("reach"), F.round(C.reward("retention", *args), 6).alias("retention"), C.best_action(*args).alias("action"))


_CASES = "SELECT source AS case_id, lang AS objective, d.doc_id AS candidate_id, n_chars, CASE WHEN toxic = 1 THEN 'bad' WHEN quality = 1 THEN 'good' WHEN d.doc_id % 3 = 0 THEN 'unclear' END AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL"


def _cases(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").filter("quality is not null")
    label = F.when(F.col("toxic") == 1, "bad").when(F.col("quality") == 1, "good").when(F.col("doc_id") % 3 == 0, "unclear")
    return j.select(F.col("source").alias("case_id"), F.col("lang").alias("objective"), F.col("doc_id").alias("candidate_id"), "n_chars", label.alias("label"))


@PLANS.add(f"""WITH c AS ({_CASES}), p AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE label = 'good') AS g, count(*) FILTER (WHERE label = 'unclear') AS u, count(*) FILTER (WHERE label = 'bad') AS b, count(*) FILTER (WHERE label IS NULL) AS x FROM c GROUP BY case_id)
SELECT count(*) AS cases, sum(n)::BIGINT AS candidates, sum(g)::BIGINT AS good, sum(u)::BIGINT AS unclear, sum(b)::BIGINT AS bad, sum(x)::BIGINT AS unlabeled, sum(g * u + g * b + u * b)::BIGINT AS preferences FROM p""")
def benchmark_summary(spark, d):
    return B.summary(_cases(spark, d))


_METRICS = f"""c AS ({_CASES}), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, candidate_id) AS position, CASE label WHEN 'good' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END AS rel FROM c), i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rel DESC, candidate_id) AS i FROM r),
a AS (SELECT case_id, count(*) FILTER (WHERE position <= 10) AS shown, count(*) FILTER (WHERE label = 'good') AS good, sum(CASE WHEN position <= 10 THEN (2**rel - 1) / log2(position + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN (2**rel - 1) / log2(i + 1) ELSE 0 END) AS best,
count(*) FILTER (WHERE position <= 10 AND label = 'good') AS g, count(*) FILTER (WHERE position <= 10 AND label = 'unclear') AS u, count(*) FILTER (WHERE position <= 10 AND label = 'bad') AS b, min(position) FILTER (WHERE position <= 10 AND label = 'good') AS first FROM i GROUP BY case_id),
m AS (SELECT case_id, (good > 0)::INT::DOUBLE AS has_good_labels, round(g / shown, 6) AS good_rate, round(u / shown, 6) AS unclear_rate, round(b / shown, 6) AS bad_rate, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg, round(CASE WHEN good > 0 THEN coalesce(1.0::DOUBLE / first, 0) END, 6) AS mrr, round(CASE WHEN good > 0 THEN g / good END, 6) AS recall FROM a)"""


def _case_metrics(spark, d):
    w = Window.partitionBy("case_id").orderBy(F.desc("n_chars"), "candidate_id")
    return B.case_metrics(_cases(spark, d).withColumn("position", F.row_number().over(w)), 10)


@PLANS.add(f"WITH {_METRICS} SELECT * FROM m")
def benchmark_case_metrics(spark, d):
    return _case_metrics(spark, d)


@PLANS.add(f"WITH {_METRICS} SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("has_good_labels", "good_rate", "unclear_rate", "bad_rate", "ndcg", "mrr", "recall")) + " FROM m")
def benchmark_metrics(spark, d):
    return B.aggregate_metrics(_case_metrics(spark, d))


@PLANS.add("""WITH h AS (SELECT max(o_orderdate) AS f FROM (SELECT o_orderdate FROM orders ORDER BY o_orderdate LIMIT 10)), r AS (SELECT o_orderkey, o_orderpriority, sha256('7|' || o_orderkey) AS h FROM orders, h WHERE o_orderdate > f),
t AS (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY h) > 3)::INT AS over FROM r), s AS (SELECT *, row_number() OVER (ORDER BY over, h) AS position FROM t)
SELECT o_orderkey, o_orderpriority, position, ['reach', 'engagement', 'conversion'][(position - 1) % 3 + 1] AS objective FROM s WHERE position <= 25""")
def case_selection(spark, d):
    """25 queries in a seeded order, three of a topic first."""
    return B.select_cases(table(spark, d, "orders"), "o_orderkey", "o_orderdate", "o_orderpriority", ["reach", "engagement", "conversion"], 25, 7, 10, 3)


@PLANS.add("""WITH r AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'reach' WHEN 1 THEN 'engagement' ELSE 'conversion' END AS o, o_orderkey, o_totalprice, ((o_orderkey % 10) / 10.0) * least(1, (o_custkey % 7) / 5.0) AS score FROM orders),
l AS (SELECT o, list_sort(list(o_totalprice)) AS s, count(*) AS n FROM r GROUP BY o), g AS (SELECT r.o, o_orderkey, score, n, (o_totalprice >= s[least(round_even(n / 4, 0), n - 1)::INT + 1])::INT + (o_totalprice >= s[least(round_even(n / 2, 0), n - 1)::INT + 1])::INT + (o_totalprice >= s[least(round_even(n * 3 / 4, 0), n - 1)::INT + 1])::INT AS grade FROM r JOIN l ON r.o = l.o),
k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY score DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY o ORDER BY grade DESC, o_orderkey) AS i FROM g)
SELECT o AS objective, any_value(n) AS n_rows, round(sum(CASE WHEN r <= 10 THEN (2**grade - 1) / log2(r + 1) ELSE 0 END) / sum(CASE WHEN i <= 10 THEN (2**grade - 1) / log2(i + 1) ELSE 0 END), 6) AS ndcg, round(coalesce(max(CASE WHEN r <= 10 AND grade > 0 THEN 1.0::DOUBLE / r END), 0), 6) AS mrr FROM k GROUP BY o""")
def trajectory_evaluation(spark, d):
    k = F.col("o_orderkey")
    p = (k % 10) / 10.0
    rows = table(spark, d, "orders").select(F.when(k % 3 == 0, "reach").when(k % 3 == 1, "engagement").otherwise("conversion").alias("objective"), k.alias("item"), p.alias("spike"), p.alias("balanced"), p.alias("durable"), ((F.col("o_custkey") % 7) / 5.0).alias("confidence"), F.col("o_totalprice").alias("z"))
    return B.trajectory_eval(rows, 10)


@PLANS.add("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def queue_status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@PLANS.add("""SELECT conv_id, count(*) AS n, string_agg(turn::VARCHAR, ',' ORDER BY turn DESC) AS turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE trim("text") <> '') WHERE r <= 3 GROUP BY conv_id""")
def recent_comments(spark, d):
    c = M.recent(table(spark, d, "conversations"), "conv_id", "text", "turn", 3)
    return c.select("conv_id", F.size("comments").cast("long").alias("n"), F.array_join(F.transform("comments", lambda x: x["at"].cast("string")), ",").alias("turns"))


@PLANS.add("""SELECT user_id, max((props->>'$.k')::BIGINT) AS reply_count FROM events WHERE ts <= TIMESTAMP '2024-01-20' AND ts + to_hours((event_id * 7919) % 120) <= TIMESTAMP '2024-01-20' GROUP BY user_id""")
def reply_counts_as_of(spark, d):
    """The largest count of the snapshots that were known."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("ingested", F.col("ts") + F.make_dt_interval(hours=((F.col("event_id") * 7919) % 120).cast("int")))
    return M.reply_counts(e, "user_id", "ts", "ingested", "k", F.lit("2024-01-20").cast("timestamp_ntz"))


_WORDS3 = "list_filter(string_split_regex(regexp_replace(lower(\"text\"), '[#,./?!-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3)"


@PLANS.add(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct({_WORDS3}))[1:24], ',') AS terms FROM conversations")
def value_prop_terms(spark, d):
    """The first 24 distinct words of each text in alphabetical order: every count is 1."""
    from skein.functions.text import words

    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(M.value_props(words("text", 3)), ",").alias("terms"))


@PLANS.add("""WITH s AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN NULL ELSE (turn % 10) / 10.0 END AS a, CASE WHEN turn % 4 = 0 THEN 0 ELSE 0.5 END AS c, length("text") AS v, turn % 5 = 0 AS late FROM conversations)
SELECT count(*) AS rows_total, round(avg((a IS NOT NULL)::INT), 6) AS coverage_rate, round(avg((c > 0)::INT), 6) AS alignment_coverage_rate, round(avg((coalesce(a, 0) < 0.35)::INT), 6) AS low_alignment_rate, round(avg(c), 6) AS alignment_confidence_mean, round(avg(v), 6) AS sentiment_volatility_mean, round(avg(late::INT), 6) AS late_share FROM s""")
def comment_snapshot_stats(spark, d):
    """What goes into the manifest of a comment snapshot."""
    t = F.col("turn")
    s = table(spark, d, "conversations").select(F.when(t % 4 != 0, (t % 10) / 10.0).alias("alignment_score"), F.when(t % 4 != 0, 0.5).otherwise(0.0).alias("alignment_confidence"), F.length("text").cast("double").alias("sentiment_volatility"), (t % 5 == 0).alias("late"))
    return M.snapshot_stats(s, F.col("alignment_score").isNotNull(), F.col("late"))
