"""Scalar and text functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scalars as S
from skein.functions import text as T
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()

_X = 'lower("text")'


def _least(words: str, n: int) -> str:
    return f"list_filter({words}, lambda w: length(w) >= {n})"


_WORDS = f"string_split_regex(regexp_replace({_X}, '[#,./?!-]', ' ', 'g'), '\\s+')"


@PLANS.add(f"""SELECT conv_id, turn, len({_least(_WORDS, 2)}) AS n_words, len(regexp_extract_all({_X}, '[a-z0-9'']+')) AS n_plain, len(list_distinct({_least(f"regexp_extract_all({_X}, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')", 2)})) AS n_unicode,
len(list_filter(string_split(regexp_replace({_X}, '[^0-9a-z#_]+', ' ', 'g'), ' '), lambda w: w <> '')) AS n_alnum FROM conversations""")
def token_variants(spark, d):
    n = lambda c: F.size(c).cast("long")
    return table(spark, d, "conversations").select("conv_id", "turn", n(T.words("text")).alias("n_words"), n(T.plain_words("text")).alias("n_plain"), n(T.unicode_words("text")).alias("n_unicode"), n(T.alnum_words("text")).alias("n_alnum"))


def _grams3(w: str) -> str:
    return f"list_distinct(list_transform(range(1, length({w}) - 1), lambda i: substr({w}, i, 3)))"


@PLANS.add(f"""WITH w AS (SELECT conv_id, turn, {_least(_WORDS, 2)} AS w FROM conversations), p AS (SELECT conv_id, turn, w[1] AS a, w[2] AS b FROM w WHERE len(w) >= 2), g AS (SELECT conv_id, turn, {_grams3("a")} AS a, {_grams3("b")} AS b FROM p)
SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM g""")
def ngram_similarity(spark, d):
    """Character 3-gram similarity of the first two words of each turn."""
    w = table(spark, d, "conversations").select("conv_id", "turn", T.words("text").alias("w")).filter(F.size("w") >= 2)
    return w.select("conv_id", "turn", F.round(T.tag_jaccard(F.get("w", F.lit(0)), F.get("w", F.lit(1))), 6).alias("similarity"))


_CAPTION = "\"url\" || ' @Ann  said #Tag' || (page_id % 7) || ' www.x.org/' || page_id || ' #tag' || (page_id % 7) || ' end'"


@PLANS.add(f"""WITH c AS (SELECT page_id, {_CAPTION} AS c FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, 'https?://\\S+|www\\.\\S+', ' ', 'g'), '@[\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '#[\\p{{L}}\\p{{N}}_]+', ' ', 'g'), '\\s+', ' ', 'g')) AS caption,
array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(c), '#[\\p{{L}}\\p{{N}}_]+'), CASE WHEN page_id % 2 = 0 THEN ['#extra', '#tag' || (page_id % 7)] ELSE [] END))), ',') AS tags FROM c""")
def caption_tags(spark, d):
    """Captions without URLs, mentions and tags; tags of the caption and listed ones, each once."""
    n = (F.col("page_id") % 7).cast("string")
    c = F.concat(F.col("url"), F.lit(" @Ann  said #Tag"), n, F.lit(" www.x.org/"), F.col("page_id").cast("string"), F.lit(" #tag"), n, F.lit(" end"))
    listed = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("Extra"), F.concat(F.lit("#TAG"), n), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    p = table(spark, d, "pages").select("page_id", c.alias("c"), listed.alias("l"))
    return p.select("page_id", T.clean_caption("c").alias("caption"), F.array_join(F.array_sort(T.combined_hashtags("c", "l")), ",").alias("tags"))


_STOP = "['" + "', '".join(T.STOPWORDS) + "']"


@PLANS.add(f"""SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'none') AS role, coalesce(CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN lower(trim(role)) END, {_least(_WORDS, 2)}[1], 'general') AS topic,
CASE WHEN contains({_X}, 'the') OR contains({_X}, 'que') THEN 'first' WHEN contains({_X}, 'er') THEN 'second' ELSE 'general' END AS kind, len(list_filter({_least(_WORDS, 3)}, lambda w: NOT list_contains({_STOP}, w))) AS n_content FROM conversations""")
def text_buckets(spark, d):
    """Non-blank values with a fallback, topics, content types by substring, content words."""
    search = F.when(F.col("turn") % 3 == 1, F.col("role"))
    none = F.array().cast("array<string>")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.safe_strip("role", F.lit("none")).alias("role"), T.infer_topic(search, none, "text").alias("topic"),
        T.content_type("text", [("first", ["the", "que"]), ("second", ["er"])]).alias("kind"), F.size(T.content_words("text")).cast("long").alias("n_content"),
    )


@PLANS.add("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS canonical, sha1(c_name || '|' || c_custkey) AS short FROM customer""")
def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.canonical_hash("c_name", "c_custkey").alias("canonical"), F.sha1(F.concat_ws("|", "c_name", F.col("c_custkey").cast("string"))).alias("short"))


_LOCALE = "CASE doc_id % 4 WHEN 0 THEN upper(lang) || '-XX' WHEN 1 THEN ' ' || lang || '_yy ' WHEN 2 THEN lang ELSE '12' END"


@PLANS.add(f"""SELECT doc_id, nullif(lower(regexp_extract(trim({_LOCALE}), '^([A-Za-z]{{2,3}})([-_].*)?$', 1)), '') AS language, 'http://example.org/A/' || doc_id AS url FROM documents""")
def language_and_url(spark, d):
    k = F.col("doc_id") % 4
    locale = F.when(k == 0, F.concat(F.upper("lang"), F.lit("-XX"))).when(k == 1, F.concat(F.lit(" "), F.col("lang"), F.lit("_yy "))).when(k == 2, F.col("lang")).otherwise("12")
    url = F.concat(F.lit(" HTTP://Example.ORG/A/"), F.col("doc_id").cast("string"), F.lit("/?q=1#top"))
    return table(spark, d, "documents").select("doc_id", T.normalise_language(locale).alias("language"), T.normalise_url(url).alias("url"))


@PLANS.add("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts) AS back, round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9, 4) AS hours, strftime(ts, '%Y-%m') AS shard, round(sin(hour(ts) * pi() / 12), 9) + 0.0 AS sin_hour, round(cos(hour(ts) * pi() / 12), 9) + 0.0 AS cos_hour, hour(ts) AS hour FROM events""")
def time_functions(spark, d):
    """ISO text there and back, age in hours, month shards, hours on a circle."""
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    sin, cos = S.cyclic_hour("t")
    iso = S.format_iso("t")
    return e.select("event_id", iso.alias("iso"), S.parse_iso(iso).cast("timestamp_ntz").alias("back"), S.hours_between(F.lit("2024-02-01").cast("timestamp"), "t").alias("hours"), S.month_shard("t").alias("shard"), F.round(sin, 9).alias("sin_hour"), F.round(cos, 9).alias("cos_hour"), F.hour("t").cast("long").alias("hour"))


@PLANS.add("""SELECT event_id, least(60.0 * power(2, event_id % 12 - 1), 21600.0) AS retry_after, round(power(2, -(event_id % 90) / 18.0), 9) AS freshness, round(1 / (1 + exp(-(value - 10) / 5)), 9) AS target FROM events""")
def backoff_and_decay(spark, d):
    return table(spark, d, "events").select("event_id", S.backoff_seconds(60.0, F.col("event_id") % 12).alias("retry_after"), F.round(S.half_life(F.col("event_id") % 90, 18.0), 9).alias("freshness"), F.round(S.sigmoid((F.col("value") - 10) / 5), 9).alias("target"))


@PLANS.add("""WITH z AS (SELECT c_custkey, c_acctbal / 2000 - 2 AS z, (c_acctbal * 200)::BIGINT AS n FROM customer) SELECT c_custkey, CASE WHEN z >= 1 THEN 3 WHEN z >= 0.3 THEN 2 WHEN z >= -0.3 THEN 1 ELSE 0 END AS label, CASE WHEN n < 10000 THEN 'nano' WHEN n < 100000 THEN 'micro' WHEN n < 1000000 THEN 'macro' ELSE 'mega' END AS size FROM z""")
def labels_and_sizes(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 2000 - 2).alias("z"), F.round(F.col("c_acctbal") * 200).cast("long").alias("n"))
    return c.select("c_custkey", S.relevance_label("z").alias("label"), S.follower_bucket("n").alias("size"))


@PLANS.add(f"""WITH w AS (SELECT conv_id, turn, list_distinct({_least(_WORDS, 2)}) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, len(list_intersect(a, b)) AS n_both, len(list_distinct(list_concat(a, b))) AS n_any, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS n_only, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM p""")
def token_set_operations(spark, d):
    """Words that neighbouring turns share, have together, and have alone."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(T.words("text")).alias("a"))
    nxt = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    n = lambda c: F.size(c).cast("long")
    return w.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", n(F.array_intersect("a", "b")).alias("n_both"), n(F.array_union("a", "b")).alias("n_any"), n(F.array_except("a", "b")).alias("n_only"), F.round(T.jaccard("a", "b"), 6).alias("similarity"))


@PLANS.add("""WITH p AS (SELECT user_id, event_type AS k, sum(CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END) AS a, sum(CASE WHEN event_id % 2 = 1 THEN value ELSE 0 END) AS b FROM events GROUP BY ALL),
m AS (SELECT user_id, k, a + b AS v, (a + b) - 300 AS w FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, k) AS r, sum(greatest(w, 0)) OVER (PARTITION BY user_id) AS t FROM m)
SELECT user_id, string_agg(k, ',' ORDER BY r) FILTER (WHERE r <= 3) AS top, round(coalesce(max(CASE WHEN k = 'click' THEN greatest(w, 0) / nullif(t, 0) END), CASE WHEN max(t) > 0 THEN NULL ELSE 1.0 END), 6) AS click_share FROM r GROUP BY user_id""")
def weight_maps(spark, d):
    """Maps of a user's events summed by key, cut to the largest, and as shares with a default."""
    e = table(spark, d, "events")
    half = lambda k: F.map_from_entries(F.collect_list(F.when(F.col("h") == k, F.struct("event_type", "v"))))
    per = e.groupBy("user_id", "event_type", (F.col("event_id") % 2).alias("h")).agg(F.sum("value").alias("v"))
    m = per.groupBy("user_id").agg(half(0).alias("a"), half(1).alias("b")).select("user_id", S.merge_maps("a", "b").alias("m"))
    shares = S.normalise_weights(F.transform_values("m", lambda k, v: v - 300), {"click": 1.0})
    return m.select("user_id", F.array_join(F.map_keys(S.top_of_map("m", 3)), ",").alias("top"), F.round(F.element_at(shares, "click"), 6).alias("click_share"))


_GOOD, _BAD = ("['" + "', '".join(x) + "']" for x in (T.POSITIVE, T.NEGATIVE))


@PLANS.add(f"""WITH t AS (SELECT conv_id, turn, list_distinct({_least(f"regexp_extract_all(lower(\"text\" || CASE turn % 4 WHEN 0 THEN ' great, love it' WHEN 1 THEN ' bad but useful' WHEN 2 THEN ' terrible Problem' ELSE '' END), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')", 2)}) AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0 ELSE round((len(list_filter(w, lambda x: list_contains({_GOOD}, x))) - len(list_filter(w, lambda x: list_contains({_BAD}, x)))) / len(w), 9) END AS sentiment FROM t""")
def lexicon_sentiment(spark, d):
    """The lexicon's score of turns that hold some of its words."""
    k = F.col("turn") % 4
    more = F.when(k == 0, " great, love it").when(k == 1, " bad but useful").when(k == 2, " terrible Problem").otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.sentiment(F.concat("text", more)), 9).alias("sentiment"))
