"""Fallback signals, frames and concepts, retrieval contexts, request scopes and small reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import contracts as K
from skein.operators import fabric as X
from skein.operators import retrieval as R
from skein.operators import stats as S
from skein.operators.similarity import bm25_topk
from skein.plans.registry import Plans
from skein.plans.text import PLANS as TEXT
from skein.session import table

PLANS = Plans()

_PROFILES = ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE, {v[4]}::DOUBLE, {v[5]}::DOUBLE, '{v[6]}', '{v[7]}')" for k, v in X.SIGNALS.items())
_D = X.OTHER_SIGNALS


@PLANS.add(f"""WITH p(kind, speech, motion, tempo, energy, hook, payoff, audio, visual) AS (VALUES {_PROFILES}), c AS (SELECT conv_id, turn, ['Tutorial', 'dance', 'NEWS', 'unknown', NULL][turn % 5 + 1] AS kind, CASE WHEN turn % 3 = 0 THEN 60.0::DOUBLE END AS dur, CASE WHEN turn % 4 = 0 THEN 12.0::DOUBLE END AS spoken, trim(regexp_replace(regexp_replace(lower("text"), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM conversations),
t AS (SELECT *, list_filter(string_split(plain, ' '), lambda w: length(w) >= 2) AS w FROM c), j AS (SELECT t.*, coalesce(speech, {_D[0]}) AS speech, coalesce(motion, {_D[1]}) AS motion, coalesce(tempo, {_D[2]}) AS tempo, coalesce(hook, {_D[4]}) AS hook, coalesce(payoff, {_D[5]}) AS payoff, coalesce(audio, '{_D[6]}') AS audio, coalesce(visual, '{_D[7]}') AS visual, coalesce(dur, 35) AS duration FROM t LEFT JOIN p ON lower(t.kind) = p.kind),
a AS (SELECT *, round(least(80, greatest(4, round(greatest(8, len(w) * 0.5)))) / duration, 4) AS shot, round(least(1, greatest(0, coalesce(spoken / duration, speech))), 4) AS sr FROM j), b AS (SELECT *, round(least(1, greatest(0, shot / 1.8 + motion)), 4) AS vm FROM a)
SELECT conv_id, turn, duration::DOUBLE AS duration, shot::DOUBLE AS shot_change_rate, vm::DOUBLE AS visual_motion_score, sr::DOUBLE AS speech_ratio, len(w) AS token_count, round(least(1, len(list_distinct(w)) / greatest(len(w), 1) + 0.35), 4)::DOUBLE AS clarity_score, round(least(1, shot * 0.8 + sr * 0.2), 4)::DOUBLE AS pacing_score, round(least(8, greatest(0.5, duration * hook)), 2)::DOUBLE AS hook_timing_seconds,
round(least(duration, greatest(3, duration * payoff)), 2)::DOUBLE AS payoff_timing_seconds, tempo::DOUBLE AS tempo_bpm, CASE WHEN vm > 0.55 THEN 'high_motion' ELSE visual END AS visual_style_tag, CASE WHEN sr >= 0.55 THEN 'voice_forward' ELSE audio END AS audio_style_tag, len(list_filter(['follow', 'comment', 'save', 'share', 'link', 'bio'], lambda x: contains(plain, x))) AS n_cta FROM b""")
def signal_fallback(spark, d):
    """Signals of turns as posts without extractors."""
    t = F.col("turn")
    kind = F.get(F.array(F.lit("Tutorial"), F.lit("dance"), F.lit("NEWS"), F.lit("unknown"), F.lit(None).cast("string")), t % 5)
    hints = F.map_filter(F.create_map(F.lit("duration_seconds"), F.when(t % 3 == 0, "60"), F.lit("speech_seconds"), F.when(t % 4 == 0, "12")), lambda k, v: v.isNotNull())
    p = X.signal_fallback(table(spark, d, "conversations").select("conv_id", "turn", "text", kind.alias("content_type"), hints.alias("hints")))
    return p.select("conv_id", "turn", "duration", "shot_change_rate", "visual_motion_score", "speech_ratio", F.col("token_count").cast("long").alias("token_count"), "clarity_score", "pacing_score", "hook_timing_seconds", "payoff_timing_seconds", "tempo_bpm", "visual_style_tag", "audio_style_tag", F.size("cta_keywords").cast("long").alias("n_cta"))


_MEANS = "SELECT label, list(x ORDER BY dim) AS m FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim) GROUP BY label"


@PLANS.add(f"""WITH m AS ({_MEANS}), f AS (SELECT label, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label), r AS (SELECT e.label, vec_id, least(1, greatest(0, list_inner_product(embedding::DOUBLE[], q::DOUBLE[]))) AS near, list_distance(embedding::DOUBLE[], m) AS far FROM embeddings e JOIN m ON m.label = e.label JOIN f ON f.label = e.label),
s AS (SELECT label, vec_id, 0.6 * near + 0.4 * far / max(far) OVER (PARTITION BY label) AS s FROM r) SELECT label, vec_id, round((s - min(s) OVER (PARTITION BY label)) / (max(s) OVER (PARTITION BY label) - min(s) OVER (PARTITION BY label)), 6) AS relevance FROM s""")
def frame_relevance(spark, d):
    """Vectors of one label as frames of a video, whose first vector is its description."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("description"))
    return R.frame_relevance(e.join(first, "label"), "label", "vec_id", "embedding", "description").withColumn("relevance", F.round("relevance", 6))


@PLANS.add(f"""WITH m AS ({_MEANS}), c AS (SELECT vec_id AS concept, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 40), s AS (SELECT label, concept, list_cosine_similarity(m, v) AS similarity FROM m, c), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 9) DESC, concept) AS rank FROM s)
SELECT label, concept, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5 AND similarity > 0.15""")
def concept_match(spark, d):
    """The first 40 vectors as a vocabulary of concepts for the mean of each label."""
    e = table(spark, d, "embeddings")
    c = e.filter("vec_id < 40").select(F.col("vec_id").alias("concept"), F.col("embedding").alias("vector"))
    return R.concept_match(e, "label", "embedding", c).withColumn("similarity", F.round("similarity", 6))


@PLANS.add(f"""WITH h AS ({TEXT["bm25_topk"][1]}) SELECT item_id, string_agg(h.doc_id::VARCHAR, ',' ORDER BY rank) AS items, sum(length(coalesce("text", '')))::BIGINT + 2 * (count(*) - 1) AS context_chars FROM h JOIN documents d ON d.doc_id = h.doc_id WHERE rank <= 4 GROUP BY item_id""")
def retrieval_contexts(spark, d):
    """The whole texts of the four best documents of each benchmark item as the context of an answer."""
    docs = table(spark, d, "documents")
    hits = bm25_topk(docs.select("doc_id", T.words("text").alias("terms")), table(spark, d, "benchmark").select("item_id", T.words("text").alias("terms")), "doc_id", "item_id", 4)
    c = R.contexts(hits.select(F.col("q").alias("item_id"), F.col("d").alias("doc_id"), "rank"), docs, "item_id", "doc_id", "rank")
    return c.select("item_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.length("context").cast("long").alias("context_chars"))


@PLANS.add("""SELECT doc_id FROM documents d WHERE lang = 'en' AND (contains(lower(source), '1') OR contains(lower("text"), 'the')) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)""")
def scope_filters(spark, d):
    """English documents on a topic in text, source or tags, without an excluded set."""
    docs = table(spark, d, "documents").withColumn("language", F.col("lang"))
    named = docs.withColumn("tags", F.array("source"))
    topic = R.scope(named, "the", "EN", table(spark, d, "labels").filter("toxic = 1"), "doc_id", ["text"], "tags")
    other = R.scope(named, "1", "EN", table(spark, d, "labels").filter("toxic = 1"), "doc_id", ["source"])
    return topic.select("doc_id").unionByName(other.select("doc_id")).distinct()


@PLANS.add("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS shard FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 180 DAY AND o_orderdate < TIMESTAMP '1998-01-01' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def temporal_scope(spark, d):
    """Rows of the last 180 days before a query time, of the asked ids; the month is a partition to prune by."""
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1997-07-05").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    asked = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return o.join(asked, "o_custkey", "left_semi").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("shard"))


@PLANS.add("SELECT user_id, event_type, count(*) AS n, min(ts) AS first_seen FROM events GROUP BY user_id, event_type")
def counts_and_first_seen(spark, d):
    """Rows per author and kind, and when each was first seen."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@PLANS.add(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr(ln(1 + {a}), ln(1 + {b})), 6) AS r FROM lineitem" for a in _NUMBERS for b in _NUMBERS if a < b))
def correlation_matrix(spark, d):
    """All pairs of log1p columns in one pass."""
    li = table(spark, d, "lineitem").select(*[F.log1p(c).alias(c) for c in _NUMBERS])
    return S.pearson(li, [(a, b) for a in _NUMBERS for b in _NUMBERS if a < b])


@PLANS.add("""SELECT lang, CASE WHEN n_chars < 100 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS bucket, count(*) AS n, median(n_chars) AS median_chars, round(avg(quality), 6) AS mean_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def length_buckets(spark, d):
    b = F.when(F.col("n_chars") < 100, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang", b.alias("bucket")).agg(F.count("*").alias("n"), F.median("n_chars").alias("median_chars"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@PLANS.add("""SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length("text") DESC, turn) AS rank FROM conversations) WHERE rank <= 5""")
def longest_comments(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn")
    return table(spark, d, "conversations").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 5").select("conv_id", "turn", "rank")


@PLANS.add("""WITH v AS (SELECT l_orderkey, list_distinct(list(l_returnflag || l_linestatus)) AS tags, sum(l_extendedprice) AS worth FROM lineitem GROUP BY l_orderkey), m AS (SELECT median(worth) AS m FROM v), q AS (SELECT l_orderkey AS q, tags AS t FROM v ORDER BY worth DESC, l_orderkey LIMIT 10)
SELECT q AS query_id, l_orderkey AS candidate_id, (len(list_intersect(tags, t)) > 0 AND worth >= m)::INT + (len(list_intersect(tags, t)) > 1)::INT AS relevance FROM q, v, m WHERE q <> l_orderkey AND len(list_intersect(tags, t)) > 0""")
def relevance_proxy(spark, d):
    """Candidates that share tags with one of ten queries, relevant where they are worth the median at least."""
    v = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("tags"), F.sum("l_extendedprice").alias("worth"))
    q = v.orderBy(F.desc("worth"), "l_orderkey").limit(10).select(F.col("l_orderkey").alias("query_id"), F.col("tags").alias("t"))
    both = F.size(F.array_intersect("tags", "t"))
    j = v.crossJoin(F.broadcast(v.agg(F.median("worth").alias("m")))).crossJoin(F.broadcast(q)).filter((F.col("query_id") != F.col("l_orderkey")) & (both > 0))
    return j.select("query_id", F.col("l_orderkey").alias("candidate_id"), ((F.col("worth") >= F.col("m")).cast("int") + (both > 1).cast("int")).alias("relevance"))


@PLANS.add("""SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1) WHERE position <= 50""")
def ranked_unique(spark, d):
    """The best row of each key, then the 50 best of these with their position."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    head = table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r = 1").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)
    pos = Window.orderBy(F.desc("o_totalprice"), "o_orderkey")  # over 50 rows
    return head.select("o_orderkey", F.row_number().over(pos).cast("long").alias("position"))


@PLANS.add("""WITH s AS (SELECT event_id, (value < 1)::INT + (event_type = 'error')::INT + (props IS NULL)::INT AS bad FROM events) SELECT event_id, round(1 - 0.10 * bad, 6)::DOUBLE AS snapshot_score, round(1 - 0.15 * bad, 6)::DOUBLE AS comment_score, CASE WHEN 1 - 0.15 * bad >= 0.85 THEN 'gold' WHEN 1 - 0.15 * bad >= 0.65 THEN 'silver' WHEN 1 - 0.15 * bad >= 0.4 THEN 'bronze' ELSE 'quarantine' END AS comment_tier FROM s""")
def record_quality(spark, d):
    """Snapshots lose 0.10 and comments 0.15 for each reason."""
    e = table(spark, d, "events")
    reasons = {"low": F.col("value") < 1, "error": F.col("event_type") == "error", "bare": F.col("props").isNull()}
    a = K.with_quality(e, reasons, 0.10).select("event_id", F.col("quality_score").alias("snapshot_score"))
    b = K.with_quality(e, reasons, 0.15).select("event_id", F.col("quality_score").alias("comment_score"), F.col("quality_tier").alias("comment_tier"))
    return a.join(b, "event_id")


@PLANS.add("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 1 DAY ELSE TIMESTAMP '2024-02-01' END AS at, event_id % 3 AS rung FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def time_precedence(spark, d):
    """The first time that can be read: scraped, metrics, else the run."""
    k, iso = F.col("event_id") % 3, lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    a, b = F.when(k == 0, iso("ts")).otherwise("not a time"), F.when(k <= 1, iso(F.col("ts") + F.expr("INTERVAL 1 DAY")))
    e = table(spark, d, "events").select("event_id", F.try_to_timestamp(a).alias("a"), F.try_to_timestamp(b).alias("b"))
    return e.select("event_id", F.coalesce("a", "b", F.lit("2024-02-01").cast("timestamp")).cast("timestamp_ntz").alias("at"), F.when(F.col("a").isNotNull(), 0).when(F.col("b").isNotNull(), 1).otherwise(2).cast("long").alias("rung"))


@PLANS.add("""WITH e AS (SELECT o_custkey, l_suppkey, sum(l_quantity) AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), v AS (SELECT l_suppkey, avg(w) AS a, avg(w * w) AS b FROM e GROUP BY l_suppkey) SELECT o_custkey, round(avg(a), 6) AS x, round(avg(b), 6) AS y, count(*) AS n FROM e JOIN v ON e.l_suppkey = v.l_suppkey GROUP BY o_custkey""")
def mean_of_neighbours(spark, d):
    """A node's vector as the mean of the vectors of the nodes that it is linked to."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = j.groupBy("o_custkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    v = e.groupBy("l_suppkey").agg(F.array(F.avg("w"), F.avg(F.col("w") * F.col("w"))).alias("vector"))
    m = R.centroids(e.join(v, "l_suppkey"), "o_custkey", "vector").groupBy("o_custkey").pivot("dim", [0, 1]).agg(F.first("value"))
    return m.select("o_custkey", F.round("0", 6).alias("x"), F.round("1", 6).alias("y")).join(e.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")
