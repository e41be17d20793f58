"""Vectors, fusion, constraints, greedy reranking and graphs over the driver tables."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import graph as G
from skein.operators import retrieval as R
from skein.operators.windows import minmax_normalise
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()

_COS = """c AS (SELECT q.vec_id AS query, e.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)"""


def _cosine(spark, d, k):
    e = table(spark, d, "embeddings")
    return R.exact_topk(e, e.filter("vec_id % 100 = 0"), "vec_id", "vec_id", "embedding", k)


@PLANS.add(f"WITH {_COS} SELECT query, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM c) WHERE rank <= 10")
def vector_topk_cosine(spark, d):
    """The stated query set (every 100th row) against all rows."""
    return _cosine(spark, d, 10).withColumn("score", F.round("score", 6))


@PLANS.add("SELECT label, dim - 1 AS dim, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT AS dim FROM embeddings) GROUP BY label, dim")
def vector_centroid(spark, d):
    return R.centroids(table(spark, d, "embeddings"), "label", "embedding").withColumn("value", F.round("value", 6))


@PLANS.add(f"""WITH {_COS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS r FROM c) WHERE r <= 50), l AS (SELECT t.*, ln(1 + n_chars) AS len FROM t JOIN documents ON doc_id = item),
n AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS a, CASE WHEN max(len) OVER w > min(len) OVER w THEN (len - min(len) OVER w) / (max(len) OVER w - min(len) OVER w) ELSE 0 END AS b FROM l WINDOW w AS (PARTITION BY query)),
f AS (SELECT query, item, 0.7 * a + 0.3 * b AS fused FROM n) SELECT query, item, round(fused, 6) AS fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, item) AS rank FROM f) WHERE rank <= 10""")
def minmax_fusion_topk(spark, d):
    c = _cosine(spark, d, 50).drop("rank").join(table(spark, d, "documents").select(F.col("doc_id").alias("item"), F.log1p("n_chars").alias("len")), "item")
    n = minmax_normalise(minmax_normalise(c, "query", "score", "a"), "query", "len", "b")
    f = R.fuse(n, {"a": 0.7, "b": 0.3}, "fused", agreement=False)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("fused", 9)), "item")
    return f.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("query", "item", F.round("fused", 6).alias("fused"), "rank")


@PLANS.add("""WITH m AS (SELECT source, doc_id, lang = 'fr' AND n_chars > 5000 AND n_chars < 9000 AS t0, lang = 'fr' AND n_chars > 5000 AS t1, lang = 'fr' AS t2 FROM documents), k AS (SELECT source, CASE WHEN count(*) FILTER (WHERE t0) >= 2 THEN 0 WHEN count(*) FILTER (WHERE t1) >= 2 THEN 1 WHEN count(*) FILTER (WHERE t2) >= 2 THEN 2 ELSE 3 END AS tier FROM m GROUP BY source)
SELECT m.source, doc_id, tier FROM m JOIN k ON m.source = k.source WHERE CASE tier WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE true END""")
def constraint_tiers(spark, d):
    """Language, length and range are given up one by one until a source keeps two rows."""
    fr, long, band = F.col("lang") == "fr", F.col("n_chars") > 5000, F.col("n_chars") < 9000
    return R.relax_tiers(table(spark, d, "documents"), "source", [fr & long & band, fr & long, fr, F.lit(True)], 2).select("source", "doc_id", "tier")


@PLANS.add("""WITH a AS (SELECT source AS query, doc_id AS item, ln(1 + n_chars) / 12 AS s FROM documents), b AS (SELECT source, doc_id, quality * 0.5 + toxic * 0.1 FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, doc_id, 1.0 / (1 + doc_id % 13) FROM documents),
u AS (SELECT *, 'semantic' AS br, 20 AS k FROM a UNION ALL SELECT *, 'hashtag', 15 FROM b UNION ALL SELECT *, 'structured', 15 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query, br ORDER BY round(s, 9) DESC, item) AS rn FROM u),
m AS (SELECT query, item, max(s) FILTER (WHERE br = 'semantic') AS semantic, max(s) FILTER (WHERE br = 'hashtag') AS hashtag, max(s) FILTER (WHERE br = 'structured') AS structured FROM r WHERE rn <= k GROUP BY ALL),
f AS (SELECT *, coalesce(semantic, 0) * 0.45 + coalesce(hashtag, 0) * 0.30 + coalesce(structured, 0) * 0.25 + CASE (coalesce(semantic, 0) > 0)::INT + (coalesce(hashtag, 0) > 0)::INT + (coalesce(structured, 0) > 0)::INT WHEN 3 THEN 0.08 WHEN 2 THEN 0.04 ELSE 0 END AS score FROM m)
SELECT query, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM f) WHERE rank <= 20""")
def branch_union_topk(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("item"), "n_chars")
    lab = table(spark, d, "labels").withColumnRenamed("doc_id", "item")
    branches = {
        "semantic": docs.withColumn("s", F.log1p("n_chars") / 12),
        "hashtag": docs.join(lab, "item").withColumn("s", F.col("quality") * 0.5 + F.col("toxic") * 0.1),
        "structured": docs.withColumn("s", 1.0 / (1 + F.col("item") % 13)),
    }
    return R.branch_union(branches, "query", "item", "s", {"semantic": 20, "hashtag": 15, "structured": 15}, 20, R.BLEND).select("query", "item", F.round("score", 6).alias("score"), "rank")


_EDGES = """j AS (SELECT 'c' || o_custkey AS c, 'v' || o_orderkey AS v, 't' || p_brand AS t, o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS age, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, power(2.0, -age / 365.0) * (1 + 0.15 * ln(1 + l_quantity)) AS w FROM j), e AS (SELECT least(c, v) AS src, greatest(c, v) AS dst, 'creator_video' AS kind, w FROM w UNION ALL SELECT least(v, t), greatest(v, t), 'video_tag', w FROM w), g AS (SELECT src, dst, kind, sum(w) AS weight FROM e GROUP BY ALL)"""


def _graph(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    age = F.datediff(F.lit("2002-01-01"), "o_orderdate")
    w = G.edge_weight(age, F.lit(0), F.col("l_quantity"), 365.0)
    c, v, t = (F.concat(F.lit(p), F.col(k).cast("string")) for p, k in (("c", "o_custkey"), ("v", "o_orderkey"), ("t", "p_brand")))
    pairs = F.array(F.struct(c.alias("a"), v.alias("b"), F.lit("creator_video").alias("kind")), F.struct(v.alias("a"), t.alias("b"), F.lit("video_tag").alias("kind")))
    return G.undirected(j.select(F.explode(pairs).alias("p"), w.alias("w")).select("p.a", "p.b", "p.kind", "w"), "a", "b", "kind", "w")


@PLANS.add(f"WITH {_EDGES} SELECT src, dst, kind, round(weight, 6) AS weight FROM g")
def graph_edges(spark, d):
    return _graph(spark, d).withColumn("weight", F.round("weight", 6))


@PLANS.add(f"WITH {_EDGES}, n AS (SELECT id, sum(weight) AS strength, count(*) AS degree FROM (SELECT src AS id, weight FROM g UNION ALL SELECT dst, weight FROM g) GROUP BY id) SELECT id, degree, round(strength, 6) AS strength, round(strength / (SELECT max(strength) FROM n), 6) AS normalised FROM n")
def graph_node_strength(spark, d):
    return G.node_strength(_graph(spark, d)).select("id", "degree", F.round("strength", 6).alias("strength"), F.round("normalised", 6).alias("normalised"))


@PLANS.add()
def node2vec_embeddings(spark, d):
    """20 walks of 12 nodes from every node of the creator-tag projection, then vectors of 32 dimensions by truncated SVD of their co-occurrence."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e = j.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("t"), "p_brand").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return G.node_vectors(e).select("id", F.concat(F.lit("["), F.array_join(F.col("vector").cast("array<string>"), ","), F.lit("]")).alias("vector"))


def _candidates(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.select(
        F.col("lang").alias("query"), F.col("doc_id").alias("item"), (F.log1p("n_chars") / 12 + 0.2 * F.col("quality")).alias("score"), F.col("source").alias("author"),
        F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("topic"), (F.col("doc_id") % 4000).cast("double").alias("age_hours"), (F.col("doc_id") % 2 == 0).alias("locale_match"),
    )


@PLANS.add()
def policy_rerank(spark, d):
    return R.policy_rerank(_candidates(spark, d))


@PLANS.add()
def mmr_rerank(spark, d):
    from skein.functions.text import words

    t = table(spark, d, "documents").select(F.col("lang").alias("query"), F.explode(F.array_distinct(words("text", 4))).alias("tag")).groupBy("query", "tag").agg(F.count("*").alias("frequency"))
    return R.mmr_rerank(t.withColumn("score", F.log1p("frequency")), 15)


@PLANS.add("""WITH c AS (SELECT lang AS query, d.doc_id AS item, ln(1 + n_chars) / 12 + 0.2 * quality AS score, source AS author, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS topic, sha256(lang || '|' || d.doc_id || '|7') AS h FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
t AS (SELECT *, least((row_number() OVER (PARTITION BY query ORDER BY score DESC, item) - 1) * 3 // count(*) OVER (PARTITION BY query), 2)::INT AS band FROM c),
a AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query, author ORDER BY h) <= 2), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query, topic ORDER BY h) <= 4),
r AS (SELECT *, (row_number() OVER (PARTITION BY query, band ORDER BY h) > CASE band WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 2 END)::INT AS over FROM b), p AS (SELECT query, item, band, row_number() OVER (PARTITION BY query ORDER BY over, band, h) AS pick FROM r) SELECT * FROM p WHERE pick <= 10""")
def negative_sampling(spark, d):
    return R.negative_samples(_candidates(spark, d), "query", "item", "score", "author", "topic").select("query", "item", "band", "pick")


@PLANS.add()
def kmeans_representatives(spark, d):
    """Six clusters of the vectors and the member nearest each centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from skein.functions.scalars import dot

    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e")).withColumn("features", array_to_vector("e"))
    model = KMeans(k=6, seed=3, maxIter=20).fit(v)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "prediction int, c array<double>")
    got = model.transform(v).join(F.broadcast(centres), "prediction").withColumn("e", vector_to_array("features"))
    diff = F.zip_with("e", "c", lambda a, b: a - b)
    near = got.withColumn("distance", F.sqrt(dot(diff, diff)))
    return near.groupBy(F.col("prediction").alias("cluster")).agg(F.min_by("vec_id", F.struct("distance", "vec_id")).alias("vec_id"), F.count("*").alias("n"), F.round(F.min("distance"), 6).alias("distance"))


@PLANS.add("""WITH b AS (SELECT doc_id, (n_chars < 50)::INT + (source IS NULL)::INT + (n_chars > 5000)::INT + (lang <> 'en')::INT + (quality IS NULL)::INT + (toxic = 1)::INT AS bad FROM (SELECT d.*, quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id))
SELECT doc_id, round(greatest(0, least(1, 1 - 0.12 * bad)), 6)::DOUBLE AS quality_score, CASE WHEN 1 - 0.12 * bad >= 0.85 THEN 'gold' WHEN 1 - 0.12 * bad >= 0.65 THEN 'silver' WHEN 1 - 0.12 * bad >= 0.4 THEN 'bronze' ELSE 'quarantine' END AS quality_tier FROM b""")
def quality_tiers(spark, d):
    from skein.operators.contracts import with_quality

    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    reasons = {"short": F.col("n_chars") < 50, "missing_source": F.col("source").isNull(), "long": F.col("n_chars") > 5000, "foreign": F.col("lang") != "en", "missing_label": F.col("quality").isNull(), "toxic": F.coalesce(F.col("toxic"), F.lit(0)) == 1}
    return with_quality(j, reasons, 0.12).select("doc_id", "quality_score", "quality_tier")


def _component_rows(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "reach").when(F.col("doc_id") % 4 == 1, "engagement").when(F.col("doc_id") % 4 == 2, "conversion").otherwise("other").alias("objective"),
        ((F.col("n_chars") % 100) / 100).alias("semantic_relevance"), ((F.col("doc_id") % 10) / 10).alias("intent_alignment"), F.col("quality").cast("double").alias("performance_quality"),
        ((F.col("doc_id") % 7) / 7).alias("reference_usefulness"), (1.0 - F.col("toxic")).alias("support_confidence"), ((F.col("n_chars") % 13) / 13).alias("trajectory_alignment"),
    )


_COMP = """c AS (SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'reach' WHEN 1 THEN 'engagement' WHEN 2 THEN 'conversion' ELSE 'other' END AS objective, (n_chars % 100) / 100 AS a, (d.doc_id % 10) / 10 AS b, quality AS c, (d.doc_id % 7) / 7 AS d, 1.0::DOUBLE - toxic AS e, (n_chars % 13) / 13 AS f FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def _weights_sql():
    from skein.operators.ranking import WEIGHTS

    sums = {o: " + ".join(f"{k} * {w}::DOUBLE" for k, w in zip("abcdef", ws, strict=True)) for o, ws in WEIGHTS.items()}
    return "CASE objective " + " ".join(f"WHEN '{o}' THEN {s}" for o, s in sums.items() if o != "default") + f" ELSE {sums['default']} END"


@PLANS.add(f"WITH {_COMP} SELECT doc_id, objective, round({_weights_sql()}, 6) AS score, CASE WHEN e >= 0.75 THEN 'full' WHEN e >= 0.45 THEN 'partial' ELSE 'low' END AS support FROM c")
def ranking_components(spark, d):
    """Objective-weighted sums of the six components."""
    from skein.operators.ranking import support_level, weighted_score

    return _component_rows(spark, d).select("doc_id", "objective", weighted_score(F.col("objective")).alias("score"), support_level(F.col("support_confidence")).alias("support"))


_MIXES = [m for m in itertools.product([0.0, 0.25, 0.5, 0.75, 1.0], repeat=3) if math.isclose(sum(m), 1.0)]


@PLANS.add(f"""WITH g(mix, a, b, c) AS (VALUES {", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for i, (a, b, c) in enumerate(_MIXES))}), j AS (SELECT source, d.doc_id, greatest(quality, 0) AS rel, quality, ln(1 + n_chars) / 12 AS x, (d.doc_id % 10) / 10 AS y, 1.0::DOUBLE - toxic AS z FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT mix, source, doc_id, rel, quality, round(coalesce(x, 0) * a + coalesce(y, 0) * b + coalesce(z, 0) * c, 9) AS score FROM j, g), r AS (SELECT *, row_number() OVER (PARTITION BY mix, source ORDER BY score DESC, doc_id) AS r, row_number() OVER (PARTITION BY mix, source ORDER BY quality DESC, doc_id) AS i FROM s),
q AS (SELECT mix, source, sum(CASE WHEN r <= 10 THEN (2**rel - 1) / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN (2**rel - 1) / log2(i + 1) ELSE 0 END) AS best, round(coalesce(max(CASE WHEN r <= 10 AND quality > 0 THEN 1.0::DOUBLE / r END), 0), 6) AS mrr FROM r GROUP BY mix, source),
m AS (SELECT mix, round(avg(round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6)), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM q GROUP BY mix) SELECT m.mix, ndcg, mrr, a AS w_length, b AS w_age, c AS w_clean FROM m JOIN g ON m.mix = g.mix""")
def blend_grid_search(spark, d):
    """Which mix of three signals ranks labelled documents best within their source."""
    from skein.operators.ranking import blend_search

    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("source", "doc_id", "quality", (F.log1p("n_chars") / 12).alias("length"), ((F.col("doc_id") % 10) / 10).alias("age"), (1.0 - F.col("toxic")).alias("clean"))
    return blend_search(j, "source", "doc_id", "quality", ["length", "age", "clean"])


@PLANS.add("SELECT event_type, list_sort(list(value))[floor((count(*) - 1) * 0.95)::INT + 1] AS p95 FROM events GROUP BY event_type")
def latency_floor_percentile(spark, d):
    from skein.operators.ranking import percentile_floor

    return percentile_floor(table(spark, d, "events"), ["event_type"], "value", 0.95, "p95")


@PLANS.add(f"""WITH {_COS}, n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM c) WHERE rank <= 20), t AS (SELECT vec_id AS item, 'tag' || label AS tag, n_chars AS engagement FROM embeddings JOIN documents ON doc_id = vec_id),
j AS (SELECT query, tag, count(*) AS frequency, round(avg(engagement), 6) AS mean_engagement, round(avg(score), 6) AS mean_similarity, round(sum(score / rank), 6) AS score FROM n JOIN t ON n.item = t.item GROUP BY query, tag)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, tag) AS rank FROM j) WHERE rank <= 5""")
def neighbour_tags(spark, d):
    """Tags of the nearest vectors, weighted by similarity over rank."""
    from skein.operators import tags as N

    t = table(spark, d, "embeddings").join(table(spark, d, "documents"), F.col("vec_id") == F.col("doc_id")).select(F.col("vec_id").alias("item"), F.concat(F.lit("tag"), F.col("label").cast("string")).alias("tag"), F.col("n_chars").alias("engagement"))
    return N.neighbour_tags(_cosine(spark, d, 20), t, 5)


@PLANS.add("""SELECT event_type, event_id, round(avg(value) OVER w, 11) AS mean, max(value) OVER w AS max, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 511 PRECEDING AND CURRENT ROW)""")
def rolling_latency(spark, d):
    from skein.operators import tags as N

    return N.rolling_latency(table(spark, d, "events"), "event_type", "event_id", "value")


def _grams(relation: str, key: str) -> str:
    """(key, t, n): character 3- to 5-grams inside the padded words of a relation (key, text)."""
    words = "list_filter(string_split_regex(regexp_replace(lower(\"text\"), '[#,./?!-]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 2)"
    padded = f"SELECT {key}, ' ' || unnest({words}) || ' ' AS p FROM {relation}"
    return f"(SELECT {key}, t, count(*) AS n FROM (SELECT {key}, unnest(list_transform(range(1, length(p) - m + 2), lambda i: substr(p, i, m))) AS t FROM ({padded}), (VALUES (3), (4), (5)) v(m)) GROUP BY ALL)"


@PLANS.add(f"""WITH c AS (SELECT conv_id || ':' || turn AS k, conv_id, turn, "text" FROM conversations), tf AS (SELECT * FROM {_grams("c", "k")}), q AS (SELECT * FROM {_grams("benchmark", "item_id")}),
idf AS (SELECT t, ln((1.0 + (SELECT count(*) FROM c)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY t), dn AS (SELECT k, sqrt(sum((n * idf)**2)) AS norm FROM tf JOIN idf ON tf.t = idf.t GROUP BY k), qn AS (SELECT item_id, sqrt(sum((n * idf)**2)) AS norm FROM q JOIN idf ON q.t = idf.t GROUP BY item_id),
s AS (SELECT item_id, tf.k, sum(tf.n * q.n * idf * idf) AS dot FROM tf JOIN q ON tf.t = q.t JOIN idf ON idf.t = q.t GROUP BY ALL), r AS (SELECT s.item_id, s.k, dot / (dn.norm * qn.norm) AS score FROM s JOIN dn ON dn.k = s.k JOIN qn ON qn.item_id = s.item_id)
SELECT item_id, conv_id, turn, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, k) AS rank FROM r) x JOIN c ON c.k = x.k WHERE rank <= 5""")
def charwb_topk(spark, d):
    """Character 3- to 5-gram TF-IDF of all turns of the conversations against benchmark items."""
    from skein.functions.text import words
    from skein.operators.similarity import tfidf_topk
    from skein.operators.tags import char_terms

    docs = table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("k"), char_terms(words("text")).alias("terms"))
    queries = table(spark, d, "benchmark").select("item_id", char_terms(words("text")).alias("terms"))
    key = F.split("d", ":")
    return tfidf_topk(docs, queries, "k", "item_id", 5).select(F.col("q").alias("item_id"), key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), F.round("score", 6).alias("score"), "rank")
