"""Text, tags, comments and lexical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.scalars import safe_div, signed_hash_slot
from skein.operators.comments import alignment_windows, comment_signals_by_root, shrunk_priors
from skein.operators.similarity import bm25_topk as best_bm25
from skein.operators.similarity import cooccurrence, set_similarity_pairs, similar_sets, top_neighbours, top_per_query
from skein.operators.similarity import tfidf_topk as best_tfidf
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()


def _words(col, least=2):
    return f"list_filter(string_split_regex(regexp_replace(lower({col}), '[#,./?!-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= {least})"


_TOK = f"SELECT doc_id, unnest(list_distinct({_words('\"text\"')})) AS t FROM documents"


@PLANS.add(f"SELECT t AS token, count(*) AS n_docs FROM ({_TOK}) GROUP BY t ORDER BY n_docs DESC, token LIMIT 30")
def token_counts(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.array_distinct(T.words("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n_docs")).orderBy(F.desc("n_docs"), "token").limit(30)


@PLANS.add("""SELECT tag, count(*) AS n, sum(n_chars)::BIGINT AS engagement FROM (SELECT unnest(list_distinct(regexp_extract_all(lower("text"), '[a-z]+#'))) AS tag, n_chars FROM documents) GROUP BY tag""")
def hashtag_engagement(spark, d):
    t = table(spark, d, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+#"), F.lit(0)))).alias("tag"), "n_chars")
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.sum("n_chars").alias("engagement"))


@PLANS.add("""SELECT page_id, regexp_extract("url", '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<a href=')) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def text_clean_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@PLANS.add(f"""WITH t AS ({_TOK}), s AS (SELECT doc_id, count(*) n FROM t GROUP BY doc_id), p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM t x JOIN t y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, round(c / (s.n + u.n - c), 6) AS similarity FROM p JOIN s ON a = s.doc_id JOIN s u ON b = u.doc_id WHERE c / (s.n + u.n - c) >= 0.7""")
def jaccard_pairs(spark, d):
    sets = table(spark, d, "documents").select("doc_id", F.transform(F.array_distinct(T.words("text")), lambda w: F.xxhash64(w)).alias("s"))
    return similar_sets(sets, "doc_id", "s", 0.7).withColumn("similarity", F.round("similarity", 6))


_BOUGHT = "SELECT DISTINCT o_custkey AS k, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@PLANS.add(f"""WITH t AS ({_BOUGHT}), s AS (SELECT k, count(*) n FROM t GROUP BY k), p AS (SELECT x.k a, y.k b, count(*) c FROM t x JOIN t y ON x.p = y.p AND x.k <> y.k GROUP BY ALL),
r AS (SELECT a AS id, b AS neighbour, c / (s.n + u.n - c) AS similarity FROM p JOIN s ON a = s.k JOIN s u ON b = u.k WHERE c / (s.n + u.n - c) >= 0.05)
SELECT id, neighbour, round(similarity, 6) AS similarity, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, neighbour) AS pos FROM r) WHERE pos <= 5""")
def creator_similarity(spark, d):
    t = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("k"), F.col("l_partkey").alias("p")).distinct()
    return top_neighbours(set_similarity_pairs(t, "k", "p", 0.05), 5).select("id", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("pos").cast("long").alias("pos"))


@PLANS.add("""WITH t AS (SELECT DISTINCT l_orderkey AS k, p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.b AS t1, y.b AS t2, count(*) AS n FROM t x JOIN t y ON x.k = y.k AND x.b < y.b GROUP BY x.b, y.b""")
def tag_cooccurrence(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    return cooccurrence(t, "l_orderkey", "p_brand")


_INT = " ".join(f"WHEN regexp_matches(x, '{'|'.join(f'(?:{p})' for p in ps).replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, ps in T.INTENTS)
_NORM = "trim(regexp_replace(regexp_replace(lower(\"text\"), '[^\\p{L}\\p{N}_\\s#@?]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@PLANS.add(f"SELECT conv_id, turn, CASE {_INT} ELSE 'off_topic' END AS intent FROM (SELECT conv_id, turn, {_NORM} AS x FROM conversations)")
def intent_classes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.intent("text").alias("intent"))


#: The corpus is invented prose, so the sentiment and topic lexicons of these plans are words that occur in it.
GOOD, BAD = ["the", "and", "die", "les"], ["of", "that", "der", "que"]


def _share(words):
    return f"len(list_filter(w, lambda x: list_contains({words}, x)))"


@PLANS.add(f"""SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(({_share(GOOD)} - {_share(BAD)}) / len(w), 6) END AS sentiment
FROM (SELECT conv_id, turn, list_distinct({_words('"text"')}) AS w FROM conversations)""")
def sentiment_scores(spark, d):
    w = F.array_distinct(T.words("text"))
    n = lambda terms: F.size(F.filter(w, lambda t: t.isin(terms)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(safe_div((n(GOOD) - n(BAD)).cast("double"), F.size(w)), 6).alias("sentiment"))


@PLANS.add("""WITH r AS (SELECT conv_id, turn // 3 AS root, count(*) AS n, avg(length("text")) AS len, max(turn % 3) AS depth, sum((role = 'user')::INT) AS users FROM conversations GROUP BY ALL)
SELECT conv_id, sum(n)::BIGINT AS n_comments, count(*) AS n_roots, round(sum(n * len) / sum(n), 6) AS mean_length, max(depth) AS depth_max, round(max(n) / sum(n), 6) AS root_concentration, round(1 - count(*) / sum(n), 6) AS reply_ratio, round(sum(users) / sum(n), 6) AS user_rate FROM r GROUP BY conv_id""")
def comment_signals(spark, d):
    c = table(spark, d, "conversations").withColumn("root", F.floor(F.col("turn") / 3))
    return comment_signals_by_root(c, "conv_id", "root", F.col("turn") % 3, F.length("text"), F.col("role") == "user")


@PLANS.add(f"""WITH c AS (SELECT conv_id, turn, list_distinct({_words('"text"', 3)}) AS w FROM conversations), cap AS (SELECT conv_id, w AS cw FROM c WHERE turn = 0),
j AS (SELECT c.conv_id, turn, len(list_intersect(w, cw)) / greatest(len(w), 1) AS share FROM c JOIN cap ON c.conv_id = cap.conv_id WHERE turn > 0)
SELECT conv_id, count(*) AS n_total, count(*) FILTER (WHERE turn <= 2) AS n_early, round(avg(share), 6) AS mean_total, round(avg(share) FILTER (WHERE turn <= 2), 6) AS mean_early, round(avg(share) FILTER (WHERE turn > 2), 6) AS mean_late,
round(avg((share >= 0.1)::INT), 6) AS on_topic FROM j GROUP BY conv_id""")
def alignment_window(spark, d):
    """How far replies stay with the opening text, early and late."""
    c = table(spark, d, "conversations").withColumn("w", F.array_distinct(T.words("text", 3)))
    return alignment_windows(c, "conv_id", "turn", "w", 2, 0.1)


@PLANS.add("""WITH j AS (SELECT lang, source, d.n_chars, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), g AS (SELECT avg(quality) m FROM j), p AS (SELECT lang, source, count(*) AS n, avg(quality) AS raw FROM j GROUP BY ALL HAVING count(*) >= 3)
SELECT lang, source, n, round(n / (n + 8.0) * raw + (1 - n / (n + 8.0)) * m, 6) AS prior FROM p, g""")
def shrinkage_priors(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return shrunk_priors(j, ["lang", "source"], "quality", 8.0, 3)


_D = f"SELECT doc_id, {_words('\"text\"')} AS terms FROM documents"
_QQ = f"SELECT item_id, {_words('\"text\"')} AS terms FROM benchmark"
_TF = f"d AS ({_D}), tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS t FROM d) GROUP BY ALL), q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest(terms) AS t FROM ({_QQ})) GROUP BY ALL)"


def _sides(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.words("text").alias("terms"))
    queries = table(spark, d, "benchmark").select("item_id", T.words("text").alias("terms"))
    return docs, queries


@PLANS.add(f"""WITH {_TF}, idf AS (SELECT t, ln((1.0 + (SELECT count(*) FROM d)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY t),
w AS (SELECT doc_id, tf.t, tf * idf AS w, idf FROM tf JOIN idf ON tf.t = idf.t), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum((qtf * idf)**2)) AS qnorm FROM q JOIN idf ON q.t = idf.t GROUP BY item_id),
s AS (SELECT item_id, doc_id, sum(w * qtf * idf) AS dot FROM w JOIN q ON w.t = q.t GROUP BY ALL), r AS (SELECT s.item_id, s.doc_id, dot / (norm * qnorm) AS score FROM s JOIN n ON s.doc_id = n.doc_id JOIN qn ON s.item_id = qn.item_id)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def tfidf_topk(spark, d):
    return best_tfidf(*_sides(spark, d), "doc_id", "item_id", 10).select(F.col("q").alias("item_id"), F.col("d").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@PLANS.add(f"""WITH {_TF}, l AS (SELECT doc_id, len(terms) AS len FROM d), raw AS (SELECT t, ln((SELECT count(*) FROM d) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY t),
idf AS (SELECT t, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
r AS (SELECT item_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM l)))) AS score FROM tf JOIN q ON tf.t = q.t JOIN idf ON tf.t = idf.t JOIN l ON tf.doc_id = l.doc_id GROUP BY item_id, tf.doc_id)
SELECT item_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def bm25_topk(spark, d):
    return best_bm25(*_sides(spark, d), "doc_id", "item_id", 10).select(F.col("q").alias("item_id"), F.col("d").alias("doc_id"), F.round("score", 5).alias("score"), "rank")


@PLANS.add(f"""WITH t AS (SELECT lang, t, count(*) AS n FROM ({_TOK}) x JOIN documents USING (doc_id) GROUP BY ALL), g AS (SELECT t, sum(n) AS g FROM t GROUP BY t)
SELECT lang, t AS tag, score, rank FROM (SELECT lang, t.t, (g + 2 * n)::BIGINT AS score, row_number() OVER (PARTITION BY lang ORDER BY g + 2 * n DESC, t.t) AS rank FROM t JOIN g ON t.t = g.t) WHERE rank <= 10""")
def topic_prior_tags(spark, d):
    t = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(T.words("text"))).alias("tag")).groupBy("lang", "tag").agg(F.count("*").alias("n"))
    g = t.groupBy("tag").agg(F.sum("n").alias("g"))
    return top_per_query(t.join(g, "tag").withColumn("score", F.col("g") + 2 * F.col("n")), "lang", "tag", 10).select("lang", "tag", "score", "rank")


@PLANS.add(f"""WITH t AS ({_TOK}), h AS (SELECT doc_id, sha256(t) AS h FROM t)
SELECT doc_id, (('0x' || substr(h, 1, 8))::BIGINT % 64) AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value FROM h GROUP BY ALL""")
def signed_hash_embedding(spark, d):
    slot, sign = signed_hash_slot("t", 64)
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.words("text"))).alias("t"))
    return t.select("doc_id", slot.alias("slot"), sign.alias("s")).groupBy("doc_id", "slot").agg(F.sum("s").alias("value"))


@PLANS.add(f"""WITH t AS ({_TOK}), k AS (SELECT doc_id, list(t) AS w FROM t GROUP BY doc_id), p AS (SELECT lang, list(t) AS top FROM (SELECT lang, t, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, t) AS r FROM t JOIN documents USING (doc_id) GROUP BY lang, t) WHERE r <= 10 GROUP BY lang),
m AS (SELECT lang, len(list_intersect(w, top)) AS hit, len(w) AS n FROM documents JOIN k USING (doc_id) JOIN p USING (lang)) SELECT lang, round(avg(hit / 10), 6) AS p_at_10, round(avg(hit / n), 6) AS r_at_10, round(avg(CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / 10) * (hit / n) / (hit / 10 + hit / n) END), 6) AS f1_at_10 FROM m GROUP BY lang""")
def tag_prf1(spark, d):
    """Precision, recall and F1 of the ten most frequent tags of a topic as prediction for each row."""
    t = table(spark, d, "documents").select("doc_id", "lang", F.array_distinct(T.words("text")).alias("w")).filter(F.size("w") > 0)
    c = t.select("lang", F.explode("w").alias("t")).groupBy("lang", "t").agg(F.count("*").alias("score"))
    top = top_per_query(c, "lang", "t", 10).groupBy("lang").agg(F.collect_list("t").alias("top"))
    hit, n = F.size(F.array_intersect("w", "top")), F.size("w")
    p, r = F.col("hit") / 10, F.col("hit") / F.col("n")
    f1 = F.when(F.col("hit") == 0, 0.0).otherwise(2 * p * r / (p + r))
    return t.join(top, "lang").select("lang", hit.alias("hit"), n.alias("n")).groupBy("lang").agg(F.round(F.avg(p), 6).alias("p_at_10"), F.round(F.avg(r), 6).alias("r_at_10"), F.round(F.avg(f1), 6).alias("f1_at_10"))
