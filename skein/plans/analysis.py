"""Statistics, drift, experiments and evaluation over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.scalars import variant_bucket
from skein.operators import evaluation as E
from skein.operators import experiments as X
from skein.operators import stats as S
from skein.operators.windows import quartile_grades
from skein.plans.registry import Plans
from skein.session import table

PLANS = Plans()


@PLANS.add(" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.5), 6) AS median, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.9), 6) AS p90, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_metrics(spark, d):
    return S.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@PLANS.add("SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY o_orderpriority")
def distribution_profile(spark, d):
    return S.distribution_profile(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_quantity", "l_discount")]


@PLANS.add(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS))
def pearson_pairs(spark, d):
    return S.pearson(table(spark, d, "lineitem"), _PAIRS)


@PLANS.add("""WITH m AS (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT l.l_returnflag, round(avg((l_extendedprice - m)**3) / avg((l_extendedprice - m)**2)**1.5, 5) AS skewness, round(avg((l_extendedprice - m)**4) / avg((l_extendedprice - m)**2)**2 - 3, 5) AS kurtosis FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1""")
def skew_kurtosis(spark, d):
    return S.moments(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@PLANS.add("""WITH x AS (SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0), q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM x)
SELECT round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM x, q""")
def iqr_outliers_log10(spark, d):
    return S.iqr_outliers(table(spark, d, "orders"), F.when(F.col("o_totalprice") > 0, F.log10("o_totalprice")))


_COLS = ["user_id", "event_type", "value", "props"]


@PLANS.add(" UNION ALL ".join(f"SELECT '{c}' AS name, round(avg(({c} IS NULL)::INT), 6) AS null_rate, round(avg(coalesce(({c}::VARCHAR IN ('0', '0.0'))::INT, 0)), 6) AS zero_rate, round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events))) / greatest(count(*), 1), 6) AS duplicate_rate FROM events" for c in _COLS))
def null_dup_scorecard(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("value") == 0, F.lit("0")).otherwise(F.col("value").cast("string")))
    return S.scorecard(e, _COLS, ["user_id", "event_type"])


@PLANS.add("""SELECT CASE WHEN p_size <= 10 THEN '01-10' WHEN p_size <= 25 THEN '11-25' ELSE '26+' END AS bucket, count(*) AS n, round(avg(l_extendedprice), 6) AS mean, median(l_quantity) AS median_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def duration_buckets(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    b = F.when(F.col("p_size") <= 10, "01-10").when(F.col("p_size") <= 25, "11-25").otherwise("26+")
    return j.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.median("l_quantity").alias("median_quantity"))


@PLANS.add("""WITH m AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders)::TIMESTAMP, (SELECT max(o_orderdate) FROM orders)::TIMESTAMP, INTERVAL 1 MONTH)) AS month)
SELECT strftime(month, '%Y-%m') AS month, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM m LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON date_trunc('month', o_orderdate) = month GROUP BY 1""")
def monthly_resample(spark, d):
    """Months without rows are filled from a generated calendar."""
    o = table(spark, d, "orders")
    cal = o.agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.max("o_orderdate").cast("date").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m"))
    p = o.filter("o_orderstatus = 'P'").groupBy(F.trunc("o_orderdate", "month").alias("k")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    return cal.join(p, F.col("m") == F.col("k"), "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


#: The first half of the month is the reference, the second the present.
_MID = "2024-01-16"


def _halves(spark, d):
    e = table(spark, d, "events")
    return e.filter(f"ts < timestamp_ntz'{_MID}'"), e.filter(f"ts >= timestamp_ntz'{_MID}'")


_SAMPLES = f"x AS (SELECT '' AS name, (ts >= TIMESTAMP '{_MID}')::INT AS s, value AS x FROM events)"


def _psi_sql(samples: str) -> str:
    """(name, n_reference, n_current, psi) of a relation (name, s, x)."""
    return f"""(WITH sp AS (SELECT name, min(x) AS lo, max(x) AS hi, count(*) FILTER (WHERE s = 0) AS n0, count(*) FILTER (WHERE s = 1) AS n1 FROM {samples} GROUP BY name),
bins AS (SELECT name, i, lo + (hi - lo) / 10 * i AS a, CASE WHEN i = 9 THEN hi ELSE lo + (hi - lo) / 10 * i + (hi - lo) / 10 END AS z FROM sp, range(10) r(i)),
c AS (SELECT bins.name, i, count(*) FILTER (WHERE s = 0) AS c0, count(*) FILTER (WHERE s = 1) AS c1 FROM bins LEFT JOIN {samples} x ON bins.name = x.name AND x >= a AND x <= z GROUP BY bins.name, i),
p AS (SELECT c.name, greatest(c0 / greatest(n0, 1), 1e-9) AS p, greatest(c1 / greatest(n1, 1), 1e-9) AS q FROM c JOIN sp ON c.name = sp.name)
SELECT sp.name, n0 AS n_reference, n1 AS n_current, CASE WHEN n0 = 0 OR n1 = 0 OR hi <= lo THEN 0 ELSE (SELECT sum((q - p) * ln(q / p)) FROM p WHERE p.name = sp.name) END AS psi FROM sp)"""


def _ks_sql(samples: str) -> str:
    """(name, ks)."""
    return f"""(SELECT name, max(CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE abs(a / na - b / nb) END) AS ks FROM (SELECT name, sum((s = 0)::INT) OVER w AS a, sum((s = 1)::INT) OVER w AS b, sum((s = 0)::INT) OVER (PARTITION BY name) AS na, sum((s = 1)::INT) OVER (PARTITION BY name) AS nb
FROM {samples} WINDOW w AS (PARTITION BY name ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY name)"""


def _delta_sql(samples: str) -> str:
    """(name, mean_delta)."""
    return f"""(SELECT name, CASE WHEN r IS NULL OR c IS NULL OR (abs(r) <= 1e-9 AND abs(c) <= 1e-9) THEN 0 WHEN abs(r) <= 1e-9 THEN 1 ELSE abs(c - r) / abs(r) END AS mean_delta FROM (SELECT name, avg(x) FILTER (WHERE s = 0) AS r, avg(x) FILTER (WHERE s = 1) AS c FROM {samples} GROUP BY name))"""


@PLANS.add(f"WITH {_SAMPLES} SELECT round(psi, 6) AS psi FROM {_psi_sql('x')}")
def psi_drift(spark, d):
    return S.psi(*_halves(spark, d), "value").select(F.round("psi", 6).alias("psi"))


@PLANS.add(f"WITH {_SAMPLES} SELECT round(ks, 6) AS ks FROM {_ks_sql('x')}")
def ks_drift(spark, d):
    return S.ks(*_halves(spark, d), "value").select(F.round("ks", 6).alias("ks"))


@PLANS.add(f"WITH {_SAMPLES} SELECT round(mean_delta, 6) AS mean_delta FROM {_delta_sql('x')}")
def mean_delta(spark, d):
    return S.mean_delta(*_halves(spark, d), "value").select(F.round("mean_delta", 6).alias("mean_delta"))


_STREAMS = f"""e AS (SELECT *, (ts >= TIMESTAMP '{_MID}')::INT AS s, (props->>'$.k')::DOUBLE AS k FROM events),
f AS (SELECT 'mandatory_value' AS name, s, value AS x FROM e UNION ALL SELECT 'optional_k', s, k FROM e WHERE k IS NOT NULL UNION ALL SELECT 'mandatory_hour', s, hour(ts)::DOUBLE FROM e),
l AS (SELECT event_type AS name, s, value AS x FROM e WHERE event_type IN ('purchase', 'signup', 'view')),
m AS (SELECT 'feature' AS stream, name, n_reference, n_current, round(psi, 6) AS psi, NULL::DOUBLE AS ks, NULL::DOUBLE AS mean_delta, least(n_reference, n_current) >= 25 AS sufficient, least(n_reference, n_current) >= 25 AND psi > CASE WHEN name LIKE 'mandatory%' THEN 0.2 ELSE 0.3 END AS breach FROM {_psi_sql('f')}
UNION ALL SELECT 'label', k.name, n0, n1, NULL, round(ks, 6), round(mean_delta, 6), least(n0, n1) >= 25, least(n0, n1) >= 25 AND (ks > 0.12 OR mean_delta > 0.2) FROM {_ks_sql('l')} k JOIN {_delta_sql('l')} d ON k.name = d.name JOIN (SELECT name, count(*) FILTER (WHERE s = 0) AS n0, count(*) FILTER (WHERE s = 1) AS n1 FROM l GROUP BY name) n ON n.name = k.name)"""


def _streams(spark, d):
    e = table(spark, d, "events").withColumn("s", (F.col("ts") >= F.lit(_MID).cast("timestamp_ntz")).cast("int")).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    one = lambda name, x: e.select(F.lit(name).alias("name"), "s", x.cast("double").alias("x")).filter("x is not null")
    features = one("mandatory_value", F.col("value")).unionByName(one("optional_k", F.col("k"))).unionByName(one("mandatory_hour", F.hour("ts")))
    labels = e.filter("event_type in ('purchase', 'signup', 'view')").select(F.col("event_type").alias("name"), "s", F.col("value").alias("x"))
    rate = lambda s, c: F.avg(F.when(F.col("s") == s, c.cast("int")))
    policy = e.agg(
        F.count_if(F.col("s") == 0).alias("baseline_n"), F.count_if(F.col("s") == 1).alias("current_n"), rate(0, F.col("event_type") == "error").alias("baseline_fallback_rate"), rate(1, F.col("event_type") == "error").alias("fallback_rate"),
        rate(1, F.col("k") > 95).alias("author_cap_drop_rate"), rate(1, F.col("k") > 85).alias("strict_language_drop_rate"), F.lit(0.0).alias("strict_locale_drop_rate"),
    )
    return features, labels, policy


@PLANS.add(f"WITH {_STREAMS} SELECT * FROM m")
def drift_measures(spark, d):
    return S.drift_measures(*_streams(spark, d)[:2])


@PLANS.add(f"""WITH {_STREAMS}, q AS (SELECT count(*) FILTER (WHERE s = 0) AS n0, count(*) FILTER (WHERE s = 1) AS n1, avg((event_type = 'error')::INT) FILTER (WHERE s = 0) AS f0, avg((event_type = 'error')::INT) FILTER (WHERE s = 1) AS f1, avg((k > 95)::INT) FILTER (WHERE s = 1) AS a, avg((k > 85)::INT) FILTER (WHERE s = 1) AS g FROM e),
b AS (SELECT bool_or(name LIKE 'mandatory%' AND breach) AS feature_mandatory, bool_or(name LIKE 'optional%' AND breach) AS feature_optional, bool_or(stream = 'label' AND breach) AS label, bool_or(stream = 'feature' AND sufficient) AND bool_or(stream = 'label' AND sufficient) AS enough FROM m),
s AS (SELECT feature_mandatory, feature_optional, label, least(n0, n1) >= 25 AND (f1 > 0.05 OR f1 - f0 > 0.02 OR a > 0.2 OR g > 0.2) AS policy, enough AND least(n0, n1) >= 25 AS sufficient FROM b, q),
v AS (SELECT *, CASE WHEN feature_mandatory OR label OR policy THEN 'critical' WHEN feature_optional THEN 'warning' WHEN NOT sufficient THEN 'insufficient_data' ELSE 'ok' END AS severity FROM s)
SELECT *, CASE severity WHEN 'critical' THEN 'retrain_candidate' WHEN 'warning' THEN 'monitor' WHEN 'insufficient_data' THEN 'insufficient_data' ELSE 'none' END AS recommendation FROM v""")
def drift_summary(spark, d):
    return S.drift_summary(*_streams(spark, d))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@PLANS.add("SELECT user_id, " + ", ".join(f"sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END)::BIGINT AS n_{k}" for k in _KINDS) + " FROM events GROUP BY user_id")
def feedback_pivot(spark, d):
    return X.event_pivot(table(spark, d, "events"), "user_id", "event_type", _KINDS)


@PLANS.add("""WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), w AS (SELECT v.event_id, count(*) FILTER (WHERE p.ts <= v.ts + INTERVAL 24 HOUR) AS n24, count(*) AS n96, round(sum(p.value), 4) AS v96 FROM v JOIN events p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 96 HOUR GROUP BY v.event_id)
SELECT v.event_id, coalesce(n24, 0) AS n24, coalesce(n96, 0) AS n96, v96 FROM v LEFT JOIN w ON v.event_id = w.event_id""")
def outcome_self_join(spark, d):
    """Outcomes of two windows from one join instead of one join per window."""
    e = table(spark, d, "events")
    v = e.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("u"), F.col("ts").alias("t"))
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    j = v.join(p, (F.col("u") == F.col("user_id")) & (F.col("ts") > F.col("t")) & (F.col("ts") <= F.col("t") + F.expr("INTERVAL 96 HOURS")))
    w = j.groupBy("event_id").agg(F.count_if(F.col("ts") <= F.col("t") + F.expr("INTERVAL 24 HOURS")).alias("n24"), F.count("*").alias("n96"), F.round(F.sum("value"), 4).alias("v96"))
    return v.select("event_id").join(w, "event_id", "left").select("event_id", F.coalesce("n24", F.lit(0)).alias("n24"), F.coalesce("n96", F.lit(0)).alias("n96"), "v96")


@PLANS.add("""SELECT c_mktsegment AS objective, count(DISTINCT user_id) AS n_users, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS n_purchases, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS any_error FROM events JOIN customer ON user_id = c_custkey GROUP BY 1""")
def objective_support(spark, d):
    j = table(spark, d, "events").join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("objective")).agg(F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"), F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("any_error"))


@PLANS.add("""SELECT count(*) AS n, round(count(*) FILTER (WHERE k > 50) / greatest(count(*), 1), 6) AS high_rate, round(count(*) FILTER (WHERE k IS NULL) / greatest(count(*), 1), 6) AS missing_rate FROM (SELECT (props->>'$.k')::INT AS k FROM events)""")
def policy_rates(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    n = F.greatest(F.count("*"), F.lit(1))
    return table(spark, d, "events").select(k.alias("k")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("k") > 50) / n, 6).alias("high_rate"), F.round(F.count_if(F.col("k").isNull()) / n, 6).alias("missing_rate"))


@PLANS.add("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce(props->>'$.missing', 'none') AS missing FROM events")
def json_field_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("missing"))


@PLANS.add("SELECT DISTINCT event_type FROM events WHERE coalesce((props->>'$.synthetic')::BOOLEAN, false) = false AND coalesce((props->>'$.injected_failure')::BOOLEAN, false) = false")
def distinct_scope(spark, d):
    flag = lambda name: F.coalesce(F.get_json_object("props", f"$.{name}").cast("boolean"), F.lit(False))
    return table(spark, d, "events").filter(~flag("synthetic") & ~flag("injected_failure")).select("event_type").distinct()


@PLANS.add("""WITH l AS (SELECT ts, event_type = 'error' OR value > 1 AS c, event_type <> 'view' AS r FROM events ORDER BY ts DESC LIMIT 60), r AS (SELECT sum((NOT (c AND r))::INT) OVER (ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS miss FROM l)
SELECT count(*) FILTER (WHERE miss = 0) AS trailing_critical, count(*) AS n_rows, true AS triggered, CASE WHEN count(*) FILTER (WHERE miss = 0) >= 2 THEN 'drift_trigger' ELSE 'scheduled_weekly' END AS reason FROM r""")
def retrain_trigger(spark, d):
    """The last 60 events read as drift rows, with a schedule that is due."""
    severity = F.when((F.col("event_type") == "error") | (F.col("value") > 1), " Critical").otherwise("ok")
    advice = F.when(F.col("event_type") != "view", "retrain_candidate").otherwise("monitor")
    return X.retrain_trigger(table(spark, d, "events").select("ts", severity.alias("severity"), advice.alias("advice")), "ts", "severity", "advice", 2, scheduled=True)


_VAR = "SELECT event_type AS objective, CASE WHEN ('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.5 THEN 'treatment' ELSE 'control' END AS variant, value, (props->>'$.k')::INT AS k FROM events"


def _variants(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("objective"), variant_bucket(F.col("user_id").cast("string"), 0.5).alias("variant"), "value", F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("high", F.col("k") > 50)


@PLANS.add(f"SELECT objective, variant, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg((k > 50)::INT), 6) AS rate, list_sort(list(k))[round_even((count(*) - 1) * 0.95, 0)::INT + 1] AS p95 FROM ({_VAR}) GROUP BY ALL")
def variant_summary(spark, d):
    return X.variant_summary(_variants(spark, d), ["objective", "variant"], "value", "high", "k")


@PLANS.add(f"""SELECT objective, n_t, n_c, round(m_t - m_c, 6) AS delta, least(n_t, n_c) >= 950 AS sufficient, CASE WHEN least(n_t, n_c) < 950 THEN 'insufficient_evidence' WHEN m_t > m_c THEN 'treatment_better' WHEN m_t < m_c THEN 'control_better' ELSE 'no_difference' END AS verdict
FROM (SELECT objective, count(*) FILTER (WHERE variant = 'treatment') AS n_t, count(*) FILTER (WHERE variant = 'control') AS n_c, avg(value) FILTER (WHERE variant = 'treatment') AS m_t, avg(value) FILTER (WHERE variant = 'control') AS m_c FROM ({_VAR}) GROUP BY objective)""")
def variant_comparison(spark, d):
    return X.variant_comparison(_variants(spark, d), "objective", "variant", "value", "treatment", "control", 950)


@PLANS.add("SELECT c_custkey, CASE WHEN ('0x' || substr(sha256('exp:' || c_custkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'treatment' ELSE 'control' END AS variant FROM customer")
def experiment_bucket(spark, d):
    return table(spark, d, "customer").select("c_custkey", variant_bucket(F.concat(F.lit("exp:"), F.col("c_custkey").cast("string")), 0.3).alias("variant"))


@PLANS.add("""WITH l AS (SELECT o_orderpriority AS g, list_sort(list(o_totalprice)) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, (o_totalprice >= s[least(round_even(n / 4, 0), n - 1)::INT + 1])::INT + (o_totalprice >= s[least(round_even(n / 2, 0), n - 1)::INT + 1])::INT + (o_totalprice >= s[least(round_even(n * 3 / 4, 0), n - 1)::INT + 1])::INT AS grade FROM orders JOIN l ON g = o_orderpriority""")
def relevance_grades(spark, d):
    return quartile_grades(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "grade").select("o_orderkey", "grade")


@PLANS.add("""WITH j AS (SELECT source, d.doc_id, n_chars, quality + toxic AS rel FROM documents d JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r, row_number() OVER (PARTITION BY source ORDER BY rel DESC, doc_id) AS i FROM j),
s AS (SELECT source, sum(CASE WHEN r <= 10 THEN (2**rel - 1) / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN (2**rel - 1) / log2(i + 1) ELSE 0 END) AS best, coalesce(max(CASE WHEN r <= 10 AND rel > 0 THEN 1.0::DOUBLE / r END), 0) AS mrr, count(*) FILTER (WHERE r <= 10 AND rel > 0) AS hit, count(*) FILTER (WHERE rel > 0) AS tot FROM r GROUP BY source)
SELECT source, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg, round(mrr, 6) AS mrr, round(CASE WHEN tot > 0 THEN hit / tot ELSE 0 END, 6) AS recall FROM s""")
def ndcg_mrr_recall(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("rel", F.col("quality") + F.col("toxic"))
    return E.ranking_metrics(j, "source", "n_chars", "rel", "doc_id", 10)


@PLANS.add("""WITH x AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS g, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ra, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rb FROM lineitem)
SELECT count(*) AS n, round(avg(abs(y - g)), 6) AS mae, round(sqrt(avg((y - g) * (y - g))), 6) AS rmse, round(1 - avg((y - g) * (y - g)) / var_pop(y), 6) AS r2, round(corr(ra, rb), 6) AS spearman FROM x""")
def regression_metrics_spearman(spark, d):
    return S.regression_metrics(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000).alias("g")), "y", "g")


@PLANS.add()
def bootstrap_lift(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("q"), (F.col("n_chars") > 1000).cast("double").alias("p"))
    return E.paired_bootstrap(j, "doc_id", "p", "q")


_FEEDBACK = {"saved": ["purchase"], "relevant": ["signup"], "not_relevant": ["error"], "weak": ["click"]}
_STATES = """SELECT user_id, k, CASE WHEN (s OR r) AND n THEN 'conflict' WHEN s THEN 'saved' WHEN r THEN 'relevant' WHEN n THEN 'not_relevant' WHEN w THEN 'weak_positive' ELSE 'unlabeled' END AS state, last_at
FROM (SELECT user_id, props->>'$.k' AS k, bool_or(event_type = 'purchase') s, bool_or(event_type = 'signup') r, bool_or(event_type = 'error') n, bool_or(event_type = 'click') w, max(ts) AS last_at FROM events GROUP BY ALL)"""


@PLANS.add(f"""WITH e AS (SELECT user_id, k, state, greatest(exp(-0.6931471805599453 / 45.0 * greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_at)) / 8.64e10, 0)), 0.1) * CASE WHEN state = 'saved' THEN 1.25 ELSE 1 END AS w FROM ({_STATES}) WHERE state IN ('saved', 'relevant', 'not_relevant')),
t AS (SELECT user_id, CASE WHEN state = 'not_relevant' THEN 'negative' ELSE 'positive' END AS polarity, 'topic' AS field, (k::INT % 7)::VARCHAR AS token, w FROM e UNION ALL SELECT user_id, CASE WHEN state = 'not_relevant' THEN 'negative' ELSE 'positive' END, 'author', (k::INT % 31)::VARCHAR, w * 0.5 FROM e),
g AS (SELECT user_id, polarity, field, token, sum(w) AS weight FROM t GROUP BY ALL)
SELECT user_id, polarity, field, token, round(weight, 6) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, polarity, field ORDER BY round(weight, 9) DESC, token) AS rank FROM g) WHERE rank <= 24""")
def creator_profile(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    items = e.select("k").distinct()
    token = lambda field, n: items.select(F.col("k").alias("item"), F.lit(field).alias("field"), (F.col("k").cast("int") % n).cast("string").alias("token"))
    now = F.lit("2024-01-31").cast("timestamp")
    return X.preference_profile(e, "user_id", "k", "event_type", "ts", now, token("topic", 7).unionByName(token("author", 31)), _FEEDBACK).withColumn("weight", F.round("weight", 6))


@PLANS.add("SELECT source, count(*) AS n, round(coalesce(regr_slope(quality, n_chars), 1), 6) AS slope, round(coalesce(regr_intercept(quality, n_chars), 0), 6) AS bias FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def calibration_fit(spark, d):
    return S.linear_calibration(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "source", "n_chars", "quality")


@PLANS.add(f"SELECT user_id, k, state, CASE state WHEN 'conflict' THEN -1 WHEN 'saved' THEN 3 WHEN 'relevant' THEN 2 WHEN 'not_relevant' THEN 0 ELSE 1 END AS priority FROM ({_STATES})")
def feedback_labels(spark, d):
    return X.resolve_feedback(table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")), ["user_id", "k"], "event_type", _FEEDBACK)


@PLANS.add("""WITH r AS (SELECT source, doc_id, n_chars, quality, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, d.doc_id) AS r FROM documents d JOIN labels l USING (doc_id))
SELECT source, round(avg(quality) FILTER (WHERE r <= 3) - avg(quality) FILTER (WHERE r > 3), 6) AS delta FROM r GROUP BY source""")
def top_vs_rest_delta(spark, d):
    from pyspark.sql import Window

    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    j = j.withColumn("r", r)
    return j.groupBy("source").agg(F.round(F.avg(F.when(F.col("r") <= 3, F.col("quality"))) - F.avg(F.when(F.col("r") > 3, F.col("quality"))), 6).alias("delta"))


@PLANS.add("""WITH j AS (SELECT o_custkey AS g, o_orderkey AS i, (o_orderstatus = 'F')::INT AS l FROM orders) SELECT a.g AS o_custkey, a.i AS winner, b.i AS loser, a.l - b.l AS margin FROM j a JOIN j b ON a.g = b.g AND a.l > b.l""")
def pairwise_preferences(spark, d):
    o = table(spark, d, "orders").withColumn("l", (F.col("o_orderstatus") == "F").cast("int"))
    return X.pairwise_rows(o, "o_custkey", "o_orderkey", "l")
