"""Sources, sinks, contracts, silver tables, features and queues, each over the driver tables and back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from skein.operators import comments as M
from skein.operators import contracts as K
from skein.operators import evaluation as E
from skein.operators import fabric as X
from skein.operators import medallion as S
from skein.operators import ranking as R
from skein.operators import retrieval as V
from skein.operators import tags as N
from skein.operators import upsert as U
from skein.plans.registry import Plans
from skein.session import shared_folder, table
from skein.sources import extracts, jsonl, manifest
from skein.streaming import events as Q

PLANS = Plans()


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written_lines(spark, d):
    """Events as JSON lines in one file per type, every 50th cut short and every 70th blank."""
    e = table(spark, d, "events")
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_type").alias("caption"), F.array(F.concat(F.lit("#T"), (F.col("event_id") % 3).cast("string"))).alias("hashtags"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scraped_at"), (F.col("value") * 10).cast("long").alias("views"), (F.col("event_id") % 5).alias("likes"), F.lit(1).alias("comments_count"), F.lit(0).alias("shares")))
    line = F.when(F.col("event_id") % 50 == 0, F.substring(good, 1, 20)).when(F.col("event_id") % 70 == 0, F.lit("  ")).otherwise(good)
    path = _folder(spark, "lines")
    e.select("event_type", line.alias("value")).repartition("event_type").write.partitionBy("event_type").text(path)
    return path


_KIND = "CASE WHEN event_id % 50 = 0 THEN 'malformed_json' WHEN event_id % 70 = 0 THEN 'blank' ELSE 'good' END"


@PLANS.add(f"SELECT event_type, kind, count(*) AS n, CASE WHEN kind = 'good' THEN sum(v)::BIGINT END AS views FROM (SELECT event_type, trunc(value * 10)::BIGINT AS v, {_KIND} AS kind FROM events) WHERE kind <> 'blank' GROUP BY event_type, kind")
def jsonl_quarantine(spark, d):
    """JSON lines written and read again: good records, and malformed lines in quarantine."""
    good, bad = jsonl.read_tolerant(spark, _written_lines(spark, d))
    kind = lambda c: F.regexp_extract(c, "event_type=([a-z]+)", 1).alias("event_type")
    a = good.groupBy(kind("file")).agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.sum("views").alias("views"))
    return a.unionByName(bad.groupBy(kind("row_key"), F.col("reason").alias("kind")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("views")).select("event_type", "kind", "n", "views"))


@PLANS.add("SELECT o_orderstatus AS source, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, true AS same_folder FROM orders GROUP BY o_orderstatus")
def bundle_round_trip(spark, d):
    """Entities written once below a folder named by their content, and read back against the manifest."""
    o = table(spark, d, "orders").withColumn("source", F.col("o_orderstatus"))
    bundle = {"orders": o.select("o_orderkey", "o_custkey", "source"), "customers": table(spark, d, "customer").select("c_custkey", "c_name")}
    root = _folder(spark, "bundle")
    folder = manifest.write_bundle(bundle, root, "v1")
    again = manifest.write_bundle(bundle, root, "v1")
    back = manifest.read_bundle(spark, folder)
    return back["orders"].join(back["customers"], F.col("o_custkey") == F.col("c_custkey")).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers"), F.lit(folder == again).alias("same_folder"))


@PLANS.add("SELECT event_type AS split, count(*) AS n, min(ts) AS first, max(ts) AS last, count(DISTINCT user_id) AS n_keys, count(*) AS n_read FROM events GROUP BY event_type")
def split_files(spark, d):
    """JSON lines by split with counts and bounds, and what is read back from each."""
    path = _folder(spark, "splits")
    e = table(spark, d, "events").withColumn("split", F.col("event_type"))
    stats = N.write_splits(e, path, "split", "ts", "user_id")
    back = spark.read.json(path).groupBy("split").agg(F.count("*").alias("n_read"))
    return stats.drop("hash").join(back, "split")


@PLANS.add("""SELECT doc_id::VARCHAR AS doc_id, '["' || lang || '","' || source || '"]' AS tags, '{"n":' || n_chars || '}' AS size FROM documents""")
def csv_export(spark, d):
    """Nested columns as JSON text in a CSV file, read back as text."""
    path = _folder(spark, "csv")
    extracts.export(table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("tags"), F.struct(F.col("n_chars").alias("n")).alias("size")), path, "csv")
    return spark.read.option("header", True).option("escape", "\\").csv(path)


@PLANS.add("SELECT l_orderkey, l_linenumber, l_quantity + coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_discount END, 0) + l_tax AS total FROM lineitem")
def snapshot_vectors(spark, d):
    """Features of a snapshot as one vector per key, missing ones 0."""
    li = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), "l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("l_discount"), "l_tax")
    v = extracts.snapshot_vectors(li, "k", ["l_quantity", "l_discount", "l_tax"])
    return v.select("k.*", (F.get("vector", F.lit(0)) + F.get("vector", F.lit(1)) + F.get("vector", F.lit(2))).alias("total"))


@PLANS.add(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(({x} IS NOT NULL)::INT), 6) AS coverage, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id" for c, x in (("quality", "quality"), ("toxic", "toxic"), ("lang", "lang"))))
def feature_coverage(spark, d):
    return manifest.coverage(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "toxic", "lang"])


@PLANS.add("""SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS kind, arg_max(props, (ts, event_id)) FILTER (WHERE event_id % 3 <> 0) AS props, max(value) AS value, min(ts) AS ts FROM events GROUP BY user_id""")
def merged_entities(spark, d):
    """The latest non-empty value of each column, the largest value and the first time."""
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))).withColumn("props", F.when(F.col("event_id") % 3 != 0, F.col("props"))).withColumn("at", F.col("ts"))
    return K.merge_latest(e, "user_id", "at", "event_id", ["kind", "props"], ["value"], ["ts"])


@PLANS.add("SELECT 'line' AS entity, l_orderkey::VARCHAR AS id, 'duplicate_id' AS reason FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return K.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey", "line")


@PLANS.add("""SELECT 'quality' AS "column", 'null' AS problem, count(*) AS rows FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL UNION ALL SELECT 'author', 'missing', 0""")
def required_columns(spark, d):
    return K.required_columns(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["lang", "quality", "author"])


@PLANS.add("""SELECT page_id, CASE WHEN length(html) > 64 THEN substr(html, 1, 60) || '...' ELSE html END AS html, 2::BIGINT AS n FROM pages""")
def sanitised_payload(spark, d):
    """Payload maps without forbidden keys, long values cut."""
    p = table(spark, d, "pages").select("page_id", F.create_map(F.lit("Token"), F.lit("x"), F.lit("url"), F.col("url"), F.lit("html"), F.col("html")).alias("payload"))
    return K.sanitise(p, "payload", ["token"], 64).select("page_id", F.element_at("payload", "html").alias("html"), F.size("payload").cast("long").alias("n"))


@PLANS.add("""SELECT o_orderkey, (o_totalprice < 2000)::INT + 2 + (o_orderdate > TIMESTAMP '2001-01-01')::INT - (o_orderkey % 4 = 0)::INT AS n_errors FROM orders""")
def post_validation(spark, d):
    """Negative counts, too few comments, future times and malformed tags of raw posts."""
    o = table(spark, d, "orders")
    none = F.array().cast(K.RAW["comments"].dataType)
    raw = o.select(
        "o_orderkey", F.when(F.col("o_totalprice") < 2000, -1).otherwise(1).alias("likes"), F.lit(1).alias("views"), F.lit(None).cast("int").alias("comments_count"), F.lit(0).alias("shares"), none.alias("comments"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("posted_at"), F.lit(None).cast("string").alias("scraped_at"),
        F.array(F.when(F.col("o_orderkey") % 4 == 0, "#ok").otherwise("not ok")).alias("hashtags"), F.lit("en-US").alias("language"),
    )
    return K.validate_posts(raw, "2001-01-01").select("o_orderkey", F.size("errors").alias("n_errors"))


@PLANS.add("SELECT 'order' AS entity, o_orderkey::VARCHAR AS id, 'after_as_of_time' AS reason FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'")
def as_of_policy(spark, d):
    return K.after_as_of(table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp")), "o_orderkey", ["at"], "2000-01-01", "order")


_BRONZE = "SELECT user_id, 'u' || user_id AS video_id, event_id, strftime(ts, '%Y-%m-%d') AS scraped_at, (value * 100)::BIGINT AS views, (event_id % 9) AS likes, (event_id % 4) AS comments_count, 1 AS shares, event_type FROM (SELECT *, floor(value * 100) / 100 AS v FROM events)"


def _bronze(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), F.col("event_id").alias("line"), F.date_format("ts", "yyyy-MM-dd").alias("scraped_at"), F.floor(F.col("value") * 100).cast("long").alias("views"), (F.col("event_id") % 9).alias("likes"), (F.col("event_id") % 4).alias("comments_count"), F.lit(1).alias("shares"),
        F.col("event_type").alias("caption"), F.array(F.lit(" #B"), F.concat(F.lit("#"), F.col("event_type")), F.lit("#b")).alias("hashtags"), F.struct(F.col("event_type").alias("author_id"), F.lit("n").alias("username"), F.col("user_id").alias("followers")).alias("author"),
        F.array(F.struct(F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")).alias("comment_id"), F.col("props").alias("text"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"), F.col("event_id").alias("likes"))).alias("comments"),
    )


_SILVER = """v AS (SELECT 'u' || user_id AS video_id, event_type AS author_id, floor(value * 100)::BIGINT AS views, event_id % 9 + event_id % 4 + 1 AS engagement_total, strftime(ts, '%Y-%m-%d') AS scraped_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS r FROM events) WHERE r = 1)"""


@PLANS.add(f"WITH {_SILVER} SELECT video_id, author_id, views, engagement_total, round(CASE WHEN views = 0 THEN 0 ELSE engagement_total / views END, 6) AS engagement_rate, scraped_at, '#b,#' || author_id AS tags FROM v")
def silver_videos(spark, d):
    """The latest row per video by time text, ties to the later row."""
    return S.silver_videos(_bronze(spark, d)).select("video_id", "author_id", "views", "engagement_total", "engagement_rate", "scraped_at", F.array_join("hashtags", ",").alias("tags"))


@PLANS.add("""SELECT 'c' || (event_id % 40) AS comment_id, 'u' || user_id AS video_id, props AS text, length(props)::BIGINT AS text_length FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 40 ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def silver_comments(spark, d):
    return S.silver_comments(_bronze(spark, d)).select("comment_id", "video_id", "text", F.col("text_length").cast("long").alias("text_length"))


@PLANS.add(f"""WITH {_SILVER}, c AS (SELECT 'u' || user_id AS video_id, count(*) AS n_comments FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 40 ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1),
a AS (SELECT event_type AS author_id, user_id AS followers FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS r FROM events) WHERE r = 1)
SELECT v.video_id, a.followers, coalesce(n_comments, 0) AS n_comments FROM v LEFT JOIN a ON v.author_id = a.author_id LEFT JOIN c ON c.video_id = v.video_id""")
def silver_full(spark, d):
    return S.silver_full(_bronze(spark, d)).select("video_id", "followers", "n_comments")


_JOBS = """SELECT o_orderkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'running' END AS status, (o_orderkey % 6)::INT AS attempts, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS ok, TIMESTAMP '2024-01-01' + to_hours((o_orderkey % 24)::INT) AS started_at, o_orderdate AS created_at FROM orders"""


def _jobs(spark, d):
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "failed").otherwise("running")
    return table(spark, d, "orders").select(
        k.alias("job_id"), status.alias("status"), (k % 6).cast("int").alias("attempts"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("ok"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("started_at"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("due_at"),
    )


@PLANS.add(f"""WITH j AS ({_JOBS}), t AS (SELECT *, status = 'running' AND ok IS NULL AND started_at < TIMESTAMP '2024-01-01 12:00:00' - INTERVAL 2 HOUR AS stale, attempts + (status = 'running' AND ok IS NOT NULL)::INT AS tries FROM j),
s AS (SELECT job_id, tries AS attempts, CASE WHEN stale THEN 'pending' WHEN status = 'running' AND ok THEN 'done' WHEN status = 'running' AND NOT ok AND tries >= 5 THEN 'exhausted' WHEN status = 'running' AND NOT ok THEN 'failed' ELSE status END AS next, status FROM t)
SELECT job_id, attempts, next AS status, CASE WHEN next = 'failed' THEN epoch(TIMESTAMP '2024-01-01 12:00:00')::BIGINT + least(60 * 2**(attempts - 1), 21600)::BIGINT END AS due FROM s""")
def retry_turn(spark, d):
    """One turn of the retry queue: done, failed with a due time, exhausted, or back to pending."""
    j = Q.next_attempt(_jobs(spark, d), F.col("ok"), "2024-01-01 12:00:00")
    return j.select("job_id", "attempts", "status", F.floor(F.unix_micros("due_at") / 1e6).cast("long").alias("due"))


@PLANS.add(f"SELECT job_id, status FROM ({_JOBS}) WHERE status IN ('pending', 'failed') AND attempts < 3 ORDER BY created_at, job_id LIMIT 20")
def job_pick(spark, d):
    return Q.pick_jobs(_jobs(spark, d), "2024-01-01 12:00:00", 3, 20).select("job_id", "status")


@PLANS.add("SELECT l_orderkey + 1000000 AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0")
def key_remap(spark, d):
    """Surrogate keys of a merged source become those of the target; rows without a match go."""
    o = table(spark, d, "orders")
    mapping = o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1000000).alias("dst"))
    return U.remap_keys(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber"), mapping, "o_orderkey")


_FABRIC = """f AS (SELECT page_id, string_split_regex(regexp_replace(lower(t), '[#,./?!-]', ' ', 'g'), '\\s+') AS w, c FROM (SELECT page_id, coalesce("url", '') || CASE page_id % 3 WHEN 0 THEN ' follow me now' ELSE '' END AS t, page_id % 3 AS c FROM pages)),
t AS (SELECT page_id, c, list_filter(w, lambda x: length(x) >= 2) AS w FROM f)"""


def _posts(spark, d):
    third, none = F.col("page_id") % 3, F.array().cast("array<string>")
    return table(spark, d, "pages").select(
        "page_id", F.col("url").alias("caption"), F.when(third == 0, "follow me now").alias("transcript_text"), F.lit(None).cast("string").alias("ocr_text"), none.alias("hashtags"), none.alias("keywords"), F.when(third == 1, 40).alias("duration_seconds"), F.when(third == 2, "Opinion").alias("content_type"),
        F.when(third == 1, F.create_map(F.lit("tempo_bpm"), F.lit("130"), F.lit("estimated_scene_cuts"), F.lit("30"))).otherwise(F.create_map().cast("map<string,string>")).alias("hints"), F.lit("2024-01-02").cast("timestamp").alias("as_of_time"), F.when(third == 0, F.lit("2024-01-01").cast("timestamp")).alias("source_updated_at"),
    )


@PLANS.add(f"""WITH {_FABRIC}, n AS (SELECT *, len(w) AS n, len(list_distinct(w)) AS u, len(list_filter(w, lambda x: list_contains({X.CTA_TERMS!r}, x))) AS cta, CASE WHEN c = 1 THEN 40 ELSE greatest(10, least(180, (len(w) - CASE WHEN c = 0 THEN 3 ELSE 0 END) * 2)) END AS dur FROM t),
h AS (SELECT *, round(greatest(1.0, dur * CASE WHEN c = 2 THEN 0.18 ELSE 0.16 END), 4) AS hook FROM n), p AS (SELECT *, round(greatest(hook + 2.0, dur * CASE WHEN c = 2 THEN 0.82 ELSE 0.78 END), 4) AS payoff FROM h)
SELECT page_id, n AS token_count, u AS unique_token_count, cta AS cta_keyword_count, round(least(1, 0.42 + u / greatest(n, 1) * 0.5 + CASE WHEN cta > 0 THEN 0.04 ELSE 0 END), 6)::DOUBLE AS clarity_score, hook::DOUBLE AS hook, payoff::DOUBLE AS payoff,
CASE WHEN c = 1 THEN 0.55::DOUBLE END AS speech_ratio, CASE WHEN c = 1 THEN 0.5::DOUBLE END AS energy, CASE WHEN c = 1 THEN 0.75::DOUBLE END AS shot_change_rate, CASE WHEN c = 1 THEN 'rapid_cut' ELSE '' END AS style, CASE WHEN c = 0 THEN 24.0::DOUBLE END AS source_age_hours FROM p""")
def fabric_features(spark, d):
    """Text, structure, audio and visual features of pages as posts."""
    f = X.extract(_posts(spark, d))
    return f.select(
        "page_id", *[F.col(f"text_features.{c}").cast("double" if c == "clarity_score" else "long").alias(c) for c in ("token_count", "unique_token_count", "cta_keyword_count", "clarity_score")], F.col("structure_features.hook_timing_seconds").alias("hook"), F.col("structure_features.payoff_timing_seconds").alias("payoff"),
        "audio_features.speech_ratio", "audio_features.energy", "visual_features.shot_change_rate", F.array_join("visual_features.style_tags", ",").alias("style"), F.element_at("text_features.missing", "ocr_text")["source_age_hours"].alias("source_age_hours"),
    )


@PLANS.add("""SELECT feature, reason, count(*) AS n FROM pages, (VALUES ('transcript_text', 'not_available', 1), ('transcript_text', 'not_available', 2), ('ocr_text', 'not_available', 0), ('ocr_text', 'not_available', 1), ('ocr_text', 'not_available', 2), ('keyphrase_count', 'not_available', 0), ('keyphrase_count', 'not_available', 1), ('keyphrase_count', 'not_available', 2),
('duration_seconds', 'not_available', 0), ('duration_seconds', 'not_available', 2), ('content_type', 'not_available', 0), ('content_type', 'not_available', 1), ('speech_ratio', 'not_available', 0), ('speech_ratio', 'not_available', 2), ('tempo_bpm', 'not_available', 0), ('tempo_bpm', 'not_available', 2), ('energy', 'not_available', 0), ('energy', 'not_available', 2),
('music_presence_score', 'not_available', 0), ('music_presence_score', 'not_available', 2), ('shot_change_rate', 'not_available', 0), ('shot_change_rate', 'not_available', 2), ('visual_motion_score', 'not_available', 0), ('visual_motion_score', 'not_available', 2)) m(feature, reason, c) WHERE page_id % 3 = c GROUP BY ALL""")
def fabric_missingness(spark, d):
    return X.missing_by_reason(X.extract(_posts(spark, d)))


@PLANS.add("""SELECT c_custkey, round(0.5 * (c_custkey % 6) + 0.1 * (c_custkey % 9) + 0.3 * (c_custkey % 2) - 0.02 * abs(c_custkey % 50 - 25), 6)::DOUBLE AS reach, round(0.4 * (c_custkey % 2) + 0.5 + 0.1 * (c_custkey % 6) - 0.05 * (c_custkey % 9 - 10)**2, 6)::DOUBLE AS engagement, round(0.45 + 0.2 * (c_custkey % 2) + 0.15 * greatest(0, 1 - abs(c_custkey % 24 - 19) / 6) - 0.02 * (c_custkey % 9), 6)::DOUBLE AS conversion FROM customer""")
def heuristic_scores(spark, d):
    k = F.col("c_custkey")
    f = {"hashtag_count": k % 6, "caption_word_count": k % 9, "content_type_general": k % 2, "content_type_review": F.lit(0), "duration_seconds": k % 50, "caption_has_question": k % 2, "content_type_tutorial": F.lit(1), "posted_hour": k % 24}
    return table(spark, d, "customer").select("c_custkey", *[F.round(R.heuristic(o, f.__getitem__), 6).alias(o) for o in ("reach", "engagement", "conversion")])


@PLANS.add("""WITH p AS (SELECT c_custkey, (c_custkey % 3) AS a, (c_custkey % 4) AS b, c_mktsegment AS v FROM customer), s AS (SELECT *, 0.5 + ((CASE WHEN a = 0 THEN 1 WHEN a = 1 THEN 3 ELSE 0 END) / 4 - (CASE WHEN b = 0 THEN 1 ELSE 0 END)) * 0.5 AS topic, 0.5 + (CASE WHEN v = 'BUILDING' THEN 2 WHEN v = 'MACHINERY' THEN 1 ELSE 0 END / 3) * 0.5 AS kind FROM p),
f AS (SELECT *, 0.42 * topic + 0.28 * 0.5 + 0.20 * kind + 0.10 * 0.5 AS fit FROM s) SELECT c_custkey, round(topic, 6) AS topic, round(kind, 6) AS kind, round(fit, 6) AS fit, round(0.4 + 0.08 * 0.6 * ((0.59 - 0.18) / 0.82) * (fit - 0.5) * 2, 6) AS score FROM f""")
def affinity_scores(spark, d):
    """Four weighted parts of a creator's affinity, and the score it shifts."""
    k = F.col("c_custkey")
    maps = lambda x: F.create_map(*[F.lit(y) for y in x]) if x else F.create_map().cast("map<string,double>")
    liked, avoided, kinds, none = maps(("t0", 1.0, "t1", 3.0)), maps(("u0", 2.0)), maps(("BUILDING", 2.0, "MACHINERY", 1.0)), maps(())
    tokens = F.array(F.concat(F.lit("t"), (k % 3).cast("string")), F.concat(F.lit("u"), (k % 4).cast("string")))
    topic, kind = R.token_affinity(tokens, liked, avoided), R.value_affinity(F.col("c_mktsegment"), kinds, none)
    fit = R.affinity({"topic": topic, "hashtags": R.token_affinity(F.array().cast("array<string>"), liked, avoided), "content_type": kind, "author": R.value_affinity(F.lit(""), liked, none)})
    return table(spark, d, "customer").select("c_custkey", F.round(topic, 6).alias("topic"), F.round(kind, 6).alias("kind"), F.round(fit, 6).alias("fit"), F.round(R.blend_affinity(F.lit(0.4), F.lit(0.59), fit, F.lit(0.6)), 6).alias("score"))


@PLANS.add("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT a.o_custkey, a.o_orderkey AS first, b.o_orderkey AS second FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.r < b.r WHERE b.r <= 5""")
def shortlist_pairs(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders")
    ranked = o.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return N.shortlist_pairs(ranked, "o_custkey", "o_orderkey", "r", 5)


@PLANS.add("""WITH t AS (SELECT DISTINCT p_size AS g, p_name AS n FROM part), x AS (SELECT a.g, a.n AS a, b.n AS b FROM t a JOIN t b ON a.g = b.g AND a.n < b.n), s AS (SELECT CASE WHEN length(a) < 3 OR length(b) < 3 THEN 0 ELSE len(list_intersect(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3)), list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3)))) / len(list_distinct(list_concat(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3)), list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))))) END AS s FROM x)
SELECT round(avg(s), 6) AS mean_similarity, round(avg((s >= 0.45)::INT), 6) AS redundant_rate, (SELECT count(DISTINCT p_name) FROM part) AS n_tags FROM s""")
def list_diversity(spark, d):
    """How alike the part names of one size are."""
    return E.diversity(table(spark, d, "part"), "p_size", "p_name")


@PLANS.add("SELECT conv_id, turn, regexp_matches(lower(\"text\"), 'th')::INT + 2 * regexp_matches(lower(\"text\"), '[0-9]')::INT AS flags FROM conversations")
def overlapping_intents(spark, d):
    m = M.overlapping_intents(F.col("text"), {"a": "th", "b": "[0-9]"})
    return table(spark, d, "conversations").withColumn("m", m).select("conv_id", "turn", (F.element_at("m", "a") + 2 * F.element_at("m", "b")).alias("flags"))


_KB = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[#,./?!-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 2))"


@PLANS.add(f"""WITH a AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, unnest({_KB.format("html")}) AS t FROM pages), q AS (SELECT item_id, unnest({_KB.format('"text"')}) AS t FROM benchmark), s AS (SELECT item_id, id, count(*) + 0.5::DOUBLE * count(*) FILTER (WHERE contains(lower(title), q.t)) AS score FROM a JOIN q ON a.t = q.t GROUP BY ALL)
SELECT item_id, id AS page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3""")
def knowledge_search(spark, d):
    """Pages that share words with benchmark items, with a bonus for words of the title."""
    from skein.functions.text import words

    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), words("html").alias("terms"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), words("text").alias("terms"))
    return V.search_knowledge(pages, items, 3).select(F.col("query").alias("item_id"), F.col("id").alias("page_id"), "score", "rank")


@PLANS.add("""WITH c AS (SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings WHERE label < 2) GROUP BY label, dim) GROUP BY label), l AS (SELECT v FROM c WHERE label = 0), n AS (SELECT v FROM c WHERE label = 1),
r AS (SELECT vec_id, list_inner_product(e, lv) / sqrt(list_inner_product(lv, lv)) - 0.7 * list_inner_product(e, nv) / sqrt(list_inner_product(nv, nv)) AS a, list_inner_product(list_reverse(e), lv) / sqrt(list_inner_product(lv, lv)) AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS e, l.v AS lv, n.v AS nv FROM embeddings, l, n)),
s AS (SELECT vec_id, (0.6 * (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + 0.3 * (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ())) / 0.9 AS p FROM r)
SELECT vec_id, round(p, 6) AS personal, round(0.16 * 0.5 * least(1, greatest(0, (0.65 * (vec_id % 10) / 10.0 + 0.35 * (vec_id % 7) / 7.0 - 0.2) / 0.8)) * (p - 0.5) * 2, 6)::DOUBLE + 0.0 AS shift FROM s""")
def personalised_scores(spark, d):
    """Two branches drawn to the centroid of liked and away from that of avoided vectors, and the shift they give."""
    e = table(spark, d, "embeddings")
    c = V.centroids(e.filter("label < 2"), "label", "embedding").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
    two = c.agg(F.max_by("v", F.col("label") == 0).alias("liked"), F.max_by("v", F.col("label") == 1).alias("disliked"))
    rows = e.withColumn("back", F.reverse("embedding")).crossJoin(F.broadcast(two))
    none = F.lit(None).cast("array<double>")
    out = V.creator_scores(rows, {"embedding": 0.6, "back": 0.3}, {"embedding": F.col("liked"), "back": F.col("liked")}, {"embedding": F.col("disliked"), "back": none})
    shift = V.creator_shift(F.col("personal"), (F.col("vec_id") % 10) / 10.0, (F.col("vec_id") % 7) / 7.0, F.lit(0.5))
    return out.select("vec_id", F.round("personal", 6).alias("personal"), F.round(shift, 6).alias("shift"))


_SHORT = "SELECT o_custkey AS query, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, least(1, o_totalprice / 600000) AS score FROM orders"


@PLANS.add(f"""WITH r AS (SELECT * FROM ({_SHORT}) WHERE rank <= 6), p AS (SELECT a.query, a.item AS l, b.item AS r, CASE WHEN a.query % 5 = 0 THEN 0.5 ELSE ((a.item * 7 + b.item * 3) % 100) / 100.0 END::DOUBLE AS prob FROM r a JOIN r b ON a.query = b.query AND a.rank < b.rank),
w AS (SELECT query, item, sum(x) AS wins FROM (SELECT query, l AS item, prob AS x FROM p UNION ALL SELECT query, r, 1 - prob FROM p) GROUP BY query, item), g AS (SELECT query, avg(abs(prob - 0.5)) * 2 AS signal FROM p GROUP BY query),
m AS (SELECT r.*, count(*) OVER (PARTITION BY r.query) AS n, coalesce(wins, 0) / greatest(count(*) OVER (PARTITION BY r.query) - 1, 1) AS rate, signal FROM r LEFT JOIN w ON w.query = r.query AND w.item = r.item LEFT JOIN g ON g.query = r.query),
t AS (SELECT *, first_value(rank) OVER (PARTITION BY query ORDER BY rate DESC, rank) AS top FROM m), c AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN coalesce(signal, 0) < 0.06 THEN 'shortlist_signal_below_threshold' WHEN top > 3 THEN 'baseline_head_guard' END AS reason FROM t),
f AS (SELECT *, round(CASE WHEN n > 1 AND reason IS NULL THEN rate ELSE score END, 6) AS learned_score, round(CASE WHEN n > 1 AND reason IS NULL THEN least(1, greatest(0, score + 0.12 * signal * 0.6 * (rate - 0.5) * 2 * abs((rate - 0.5) * 2))) ELSE score END, 6) AS reranked FROM c)
SELECT query, item, learned_score, reranked, reason, row_number() OVER (PARTITION BY query ORDER BY reranked DESC, score DESC, rank) AS position FROM f""")
def pairwise_reranking(spark, d):
    """Each customer's six largest orders as a shortlist, with the odds of every pair."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.row_number().over(w).cast("long").alias("rank"), F.least(F.lit(1.0), F.col("o_totalprice") / 600000).alias("score")).filter("rank <= 6").withColumn("fused", F.lit(0.0))
    odds = F.when(F.col("query") % 5 == 0, 0.5).otherwise(((F.col("first") * 7 + F.col("second") * 3) % 100) / 100.0)
    pairs = N.shortlist_pairs(rows, "query", "item", "rank", 6).withColumn("prob", odds)
    return R.pairwise_rerank(rows, pairs, 900).select("query", "item", "learned_score", "reranked", "reason", "position")


_WEIGHTS = {o: dict(zip(R.COMPONENTS, w, strict=True)) for o, w in R.WEIGHTS.items()}
_PART = "SELECT d.doc_id, CASE d.doc_id % 4 WHEN 0 THEN 'reach' WHEN 1 THEN 'engagement' WHEN 2 THEN 'conversion' ELSE 'default' END AS o, (n_chars % 100) / 100 AS semantic_relevance, (d.doc_id % 10) / 10 AS intent_alignment, (d.doc_id % 3) / 3 AS performance_quality, (d.doc_id % 7) / 7 AS reference_usefulness, (d.doc_id % 11) / 11 AS support_confidence, (n_chars % 13) / 13 AS trajectory_alignment FROM documents d"


@PLANS.add(f"WITH c AS ({_PART}), p AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS component, round({c} * CASE o " + " ".join(f"WHEN '{o}' THEN {_WEIGHTS[o][c]}::DOUBLE" for o in R.WEIGHTS) + " END, 6) AS contribution FROM c" for c in R.COMPONENTS) + """), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY contribution DESC, component) AS rank FROM p) SELECT doc_id, component, contribution, rank FROM r WHERE rank <= 3""")
def explanation_cards(spark, d):
    """The three components that weigh most in a document's score."""
    k = F.col("doc_id")
    parts = dict(zip(R.COMPONENTS, ((F.col("n_chars") % 100) / 100, (k % 10) / 10, (k % 3) / 3, (k % 7) / 7, (k % 11) / 11, (F.col("n_chars") % 13) / 13), strict=True))
    objective = F.when(k % 4 == 0, "reach").when(k % 4 == 1, "engagement").when(k % 4 == 2, "conversion").otherwise("default")
    c = table(spark, d, "documents").select("doc_id", objective.alias("o"), *[v.alias(n) for n, v in parts.items()])
    return c.select("doc_id", F.posexplode(R.explain(F.col("o"))).alias("pos", "x")).select("doc_id", "x.component", "x.contribution", (F.col("pos") + 1).cast("long").alias("rank"))


@PLANS.add("""SELECT DISTINCT table_name FROM (VALUES ('customer'), ('orders')) t(table_name)""")
def plan_datasets(spark, d):
    """The datasets that a plan file names for a profile, written and read as JSON."""
    path = _folder(spark, "plan")
    plan = {"profiles": {"small": {"datasets": ["orders", "customer"]}, "full": {"datasets": ["lineitem"]}}}
    spark.createDataFrame([(json.dumps(plan),)], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(x,) for x in extracts.load_plan(spark, path, "small")], "table_name string")
