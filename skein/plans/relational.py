"""Joins, latest-row windows, paging, lineage and upserts over the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators.upsert import insert_ignore, merge_best, upsert_greatest, upsert_keep_existing, upsert_overwrite, upsert_prefer_incoming
from skein.operators.windows import latest_per_key
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) rn FROM lineitem) WHERE rn = 1"


def latest_lines(spark, d):
    return latest_per_key(table(spark, d, "lineitem"), ["l_orderkey"], [F.col(c).desc() for c in ("l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice")])


@PLANS.add(f"""
WITH latest AS ({_LATEST}),
per AS (SELECT o_custkey, count(*) n_posts, max(o_totalprice) max_price, round(avg(l_quantity), 6) avg_quantity
        FROM orders LEFT JOIN latest ON o_orderkey = l_orderkey GROUP BY o_custkey)
SELECT c_custkey, coalesce(n_posts, 0)::BIGINT AS n_posts, max_price, avg_quantity FROM customer LEFT JOIN per ON c_custkey = o_custkey""")
def author_stats(spark, d):
    """Post counts and means over the latest snapshot of each author's posts."""
    posts = table(spark, d, "orders").join(latest_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = posts.groupBy("o_custkey").agg(F.count("*").alias("n_posts"), F.max("o_totalprice").alias("max_price"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n_posts", F.lit(0)).cast("long").alias("n_posts"), "max_price", "avg_quantity")


@PLANS.add(f"SELECT l_orderkey, l_shipdate, l_linenumber, l_quantity, l_extendedprice FROM ({_LATEST})")
def latest_snapshot_per_video(spark, d):
    return latest_lines(spark, d).select("l_orderkey", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice")


@PLANS.add(f"""SELECT c_custkey, c_name, count(l_orderkey) AS n_videos, max(l_extendedprice) AS max_plays, round(avg(l_extendedprice), 6) AS avg_plays
FROM customer JOIN orders ON c_custkey = o_custkey JOIN ({_LATEST}) ON o_orderkey = l_orderkey
GROUP BY c_custkey, c_name ORDER BY avg_plays DESC NULLS LAST, c_custkey LIMIT 100""")
def author_stats_latest_plays(spark, d):
    return (
        table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(latest_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("c_custkey", "c_name").agg(F.count("l_orderkey").alias("n_videos"), F.max("l_extendedprice").alias("max_plays"), F.round(F.avg("l_extendedprice"), 6).alias("avg_plays"))
        .orderBy(F.desc_nulls_last("avg_plays"), "c_custkey").limit(100)
    )


@PLANS.add("""SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
WHERE o_orderdate < TIMESTAMP '1999-01-01' OR (o_orderdate = TIMESTAMP '1999-01-01' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
def keyset_page(spark, d):
    """One page after a (time, id) cursor: the cursor is a pushed filter, the page a top-k."""
    from skein.sources.extracts import keyset_page as page

    return page(table(spark, d, "orders"), "o_orderdate", "o_orderkey", 50, ("1999-01-01", 5000)).select("o_orderkey", "o_orderdate", "o_totalprice")


@PLANS.add("""SELECT c_custkey, min(o_totalprice) AS min_price FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey
GROUP BY c_custkey ORDER BY min_price DESC NULLS LAST, c_custkey LIMIT 1400""")
def nulls_last_sort_limit(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_custkey").agg(F.min("o_totalprice").alias("min_price")).orderBy(F.desc_nulls_last("min_price"), "c_custkey").limit(1400)


@PLANS.add("""SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1) ON c_custkey = o_custkey""")
def lateral_latest(spark, d):
    """Correlated top-1 as a window: one shuffle on the key, pruned before it."""
    o = latest_per_key(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderdate")


@PLANS.add("SELECT l_orderkey, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def tags_array_agg(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("brands"))


@PLANS.add("""SELECT conv_id, count(*) AS n_comments, string_agg(turn::VARCHAR || ':' || role || ':' || length("text")::VARCHAR, '|' ORDER BY turn DESC) AS comments FROM conversations GROUP BY conv_id""")
def comments_json_agg(spark, d):
    item = F.struct("turn", F.concat_ws(":", F.col("turn").cast("string"), "role", F.length("text").cast("string")).alias("s"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_comments"), F.array_join(F.transform(F.sort_array(F.collect_list(item), asc=False), lambda x: x["s"]), "|").alias("comments"))


@PLANS.add("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_join_unlabeled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@PLANS.add("SELECT doc_id FROM documents WHERE contains(\"text\", '#') AND doc_id NOT IN (SELECT doc_id FROM labels)")
def not_exists_unlabeled(spark, d):
    return table(spark, d, "documents").filter(F.col("text").contains("#")).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@PLANS.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi_join_ids(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@PLANS.add("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') <= 3")
def correlated_count_filter(spark, d):
    n = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").filter(F.coalesce("n", F.lit(0)) <= 3).select("c_custkey")


@PLANS.add("""WITH RECURSIVE t AS (SELECT conv_id, turn, turn AS root, 0 AS level FROM conversations WHERE turn = 0
UNION ALL SELECT c.conv_id, c.turn, t.root, t.level + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1 WHERE t.level < 32)
SELECT conv_id, turn, root, level FROM t""")
def comment_lineage_recursive(spark, d):
    """Root and level of each comment from its parent, by doubling: rounds grow with the logarithm of the depth."""
    from skein.operators.lineage import lineage

    c = table(spark, d, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("id"), F.when(F.col("turn") > 0, F.struct("conv_id", (F.col("turn") - 1).alias("turn"))).alias("parent"))
    return lineage(c, "id", "parent", 32).select(F.col("id.conv_id").alias("conv_id"), F.col("id.turn").alias("turn"), F.col("root.turn").alias("root"), F.col("level").cast("int").alias("level"))


@PLANS.add("""SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS returned,
max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS any_open FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3""")
def conditional_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("any_open")).filter("n >= 3")


_CUST = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS bal, c_mktsegment AS seg FROM customer WHERE c_custkey % 4 <> 1"
_NEW = "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS bal, upper(substr(c_mktsegment, 1, 3)) AS seg FROM customer WHERE c_custkey % 4 <> 2"


def _halves(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 4 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"), F.col("c_mktsegment").alias("seg"))
    new = c.filter("c_custkey % 4 <> 2").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1).alias("bal"), F.upper(F.substring("c_mktsegment", 1, 3)).alias("seg"))
    return old, new


@PLANS.add(f"WITH o AS ({_CUST}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE c_custkey NOT IN (SELECT c_custkey FROM n)")
def upsert_overwrite_rows(spark, d):
    return upsert_overwrite(*_halves(spark, d), ["c_custkey"])


@PLANS.add(f"WITH o AS ({_CUST}), n AS ({_NEW}) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(o.bal, n.bal) AS bal, coalesce(o.seg, n.seg) AS seg FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def upsert_keep_existing_rows(spark, d):
    return upsert_keep_existing(*_halves(spark, d), ["c_custkey"])


@PLANS.add(f"WITH o AS ({_CUST}), n AS ({_NEW}) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.bal, o.bal) AS bal, coalesce(n.seg, o.seg) AS seg FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def upsert_prefer_incoming_rows(spark, d):
    return upsert_prefer_incoming(*_halves(spark, d), ["c_custkey"])


@PLANS.add(f"WITH o AS ({_CUST}), n AS ({_NEW}) SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, greatest(coalesce(o.bal, 0), coalesce(n.bal, 0)) AS bal, coalesce(n.seg, o.seg) AS seg FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def upsert_greatest_level(spark, d):
    return upsert_greatest(*_halves(spark, d), ["c_custkey"], "bal")


@PLANS.add(f"WITH o AS ({_CUST}), n AS ({_NEW}) SELECT * FROM o UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM o)")
def insert_ignore_rows(spark, d):
    return insert_ignore(*_halves(spark, d), ["c_custkey"])


@PLANS.add("SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY \"text\" ORDER BY n_chars + doc_id % 7 DESC, doc_id) rn FROM documents) WHERE rn = 1")
def merge_best_score(spark, d):
    """Files merged by key, the best-scored record of each key stays."""
    docs = table(spark, d, "documents")
    return merge_best([docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")], "text", F.col("n_chars") + F.col("doc_id") % 7, F.col("doc_id")).select("doc_id", "source", "n_chars")


@PLANS.add("""WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
SELECT 'missing_order' AS reason, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'duplicate_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'shipped_before_order', count(*) FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def fk_violations(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    on = F.col("l_orderkey") == F.col("o_orderkey")
    n = lambda df, reason: df.agg(F.lit(reason).alias("reason"), F.count("*").alias("n")).select("reason", "n")
    return (
        n(li.join(o, on, "left_anti"), "missing_order")
        .unionByName(n(li.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1"), "duplicate_line"))
        .unionByName(n(li.join(o, on).filter("l_shipdate < o_orderdate"), "shipped_before_order"))
    )


@PLANS.add("""SELECT 'orders' AS side, o_custkey AS k, count(*) AS n FROM orders GROUP BY 2 INTERSECT SELECT 'orders', c_custkey, 10 FROM customer""")
def intersect_counts(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).select(F.lit("orders").alias("side"), "k", "n")
    return o.intersect(table(spark, d, "customer").select(F.lit("orders"), "c_custkey", F.lit(10).cast("long")))


@PLANS.add("""SELECT url_key, page_id FROM (SELECT coalesce(nullif(regexp_replace("url", '[?].*$', ''), ''), 'id:' || page_id) AS url_key, page_id,
row_number() OVER (PARTITION BY coalesce(nullif(regexp_replace("url", '[?].*$', ''), ''), 'id:' || page_id) ORDER BY page_id) rn FROM pages) WHERE rn = 1""")
def dedupe_by_url(spark, d):
    key = F.coalesce(F.nullif(F.regexp_replace("url", "[?].*$", ""), F.lit("")), F.concat(F.lit("id:"), F.col("page_id").cast("string")))
    return latest_per_key(table(spark, d, "pages").withColumn("url_key", key), ["url_key"], [F.col("page_id")]).select("url_key", "page_id")


@PLANS.add("""WITH r AS (SELECT doc_id, 0 AS pri, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE lang = 'en' ORDER BY pos LIMIT 10),
f AS (SELECT doc_id, 1 AS pri, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE source = 'src0' AND doc_id NOT IN (SELECT doc_id FROM r))
SELECT doc_id, row_number() OVER (ORDER BY pri, pos) AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM f) ORDER BY rank LIMIT 24""")
def topk_priority_union(spark, d):
    """Ranked candidates first, then the pool fills up to 24."""
    docs = table(spark, d, "documents")
    ranked = docs.filter("lang = 'en'").orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", F.lit(0).alias("pri"), (-F.col("n_chars")).alias("pos"))
    pool = docs.filter("source = 'src0'").join(ranked, "doc_id", "left_anti").orderBy("doc_id").limit(24).select("doc_id", F.lit(1).alias("pri"), F.col("doc_id").alias("pos"))
    top = ranked.unionByName(pool).orderBy("pri", "pos", "doc_id").limit(24)
    return top.select("doc_id", F.row_number().over(Window.orderBy("pri", "pos", "doc_id")).cast("long").alias("rank"))
