"""Reports with all their figures: users, searches, risk, quotas, policies, logs, metrics, answers, prompts, hooks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import answers as A
from skein.operators import chunkers as C
from skein.operators import documents as D
from skein.operators import expansion as EX
from skein.operators import reports as RP
from skein.operators import retrieval as R
from skein.operators import scans as SC
from skein.operators import spans as SP
from skein.operators import store as T
from skein.operators import vectors as V
from skein.operators import versions as VS
from skein.operators.aggregation import half_split
from skein.plans.answer_queries import _NEAR
from skein.plans.deeper_queries import _EXPANDED, _ONCE, _SESSIONS, asked, with_sessions
from skein.plans.registry import query, table
from skein.sources import html as H

_Q = lambda s: "'" + s.replace("'", "''") + "'"
_W = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


@query("evt02_user_profiles", f"""
WITH RECURSIVE {_SESSIONS}, se AS (SELECT user_id, start, count(*) AS n, (max(t) - start) / 1e6 AS seconds, avg(value) / 20 AS score FROM al GROUP BY 1, 2),
 tp AS (SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS topics FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) <= 5) GROUP BY 1)
SELECT user_id, count(*) AS sessions, sum(n) AS queries, any_value(topics) AS topics, CASE WHEN avg(seconds) > 1800 AND sum(n)/count(*) > 10 THEN 'power_user' WHEN avg(seconds) > 600 AND sum(n)/count(*) > 5 THEN 'regular_user' WHEN sum(n)/count(*) > 2 THEN 'casual_user' ELSE 'light_user' END AS pattern,
 round(coalesce(avg(score) FILTER (score > 0), 0), 6) AS satisfaction, max(start) AS last_active FROM se JOIN tp USING (user_id) GROUP BY 1""")
def user_profiles(spark, d):
    s = with_sessions(spark, d)
    each = s.groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("n"), ((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.col("start")) / 1e6).alias("seconds"), (F.avg("value") / 20).alias("score"))
    counted = s.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    topics = counted.groupBy("user_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))), 1, 5), lambda x: x["event_type"]), ",").alias("topics"))
    mean = F.sum("n") / F.count(F.lit(1))
    p = each.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("queries"), RP.usage_pattern(F.avg("seconds"), mean).alias("pattern"), F.round(F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)), 6).alias("satisfaction"), F.max("start").alias("last_active"))
    return p.join(topics, "user_id").select("user_id", "sessions", "queries", "topics", "pattern", "satisfaction", "last_active")


_COMPLEX = f"0.3*least(len({_W.format('text')})/20,1)+0.2*least(length(text)/200,1)+0.2*least((length(text)-length(replace(text,'?','')))/3,1)+0.3*least(length(regexp_replace(text,'[\\p{{L}}\\p{{N}} ?]','','g'))/10,1)"


@query("evt06_search_figures", f"""
WITH q AS (SELECT text, len({_W.format('text')}) AS n, round({_COMPLEX}, 9) AS c FROM conversations WHERE role = 'user'),
 k AS (SELECT string_agg(word, ',' ORDER BY m DESC, word) AS keywords FROM (SELECT word, count(*) AS m FROM (SELECT unnest(list_transform(list_filter({_W.format('text')}, lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{L}}+$')), lambda w: lower(w))) AS word FROM q) GROUP BY 1 ORDER BY m DESC, word LIMIT 20))
SELECT count(*) AS queries, count(DISTINCT text) AS unique_queries, count(*) FILTER (n <= 3) AS short, count(*) FILTER (n > 3 AND n <= 8) AS medium, count(*) FILTER (n > 8) AS long_, round(avg(c), 6) AS average_complexity, round(max(c), 6) AS max_complexity, round(min(c), 6) AS min_complexity,
 count(*) FILTER (c < 0.3) AS simple, count(*) FILTER (c >= 0.3 AND c < 0.7) AS middling, count(*) FILTER (c >= 0.7) AS complex_, any_value(keywords) AS keywords FROM q, k""")
def search_figures(spark, d):
    """How long, how complex and about what users' queries are."""
    special = F.length(F.regexp_replace("text", r"[\p{L}\p{N} ?]", ""))
    n = F.size(X.words(F.col("text")))
    least = lambda c, by: F.least(c / by, F.lit(1.0))
    c = F.round(0.3 * least(n, 20) + 0.2 * least(F.length("text"), 200) + 0.2 * least(F.length("text") - F.length(F.replace("text", F.lit("?"), F.lit(""))), 3) + 0.3 * least(special, 10), 9)
    q = table(spark, d, "conversations").filter("role = 'user'").select("text", n.alias("n"), c.alias("c"))
    words = q.select(F.explode(F.filter(X.words(F.col("text")), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$"))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("m"))
    top = words.orderBy(F.desc("m"), "word").limit(20).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "word"))), lambda x: x["word"]), ",").alias("keywords"))
    count = lambda test: F.count(F.when(test, 1))
    told = q.agg(
        F.count(F.lit(1)).alias("queries"), F.count_distinct("text").alias("unique_queries"), count(F.col("n") <= 3).alias("short"), count((F.col("n") > 3) & (F.col("n") <= 8)).alias("medium"), count(F.col("n") > 8).alias("long_"),
        F.round(F.avg("c"), 6).alias("average_complexity"), F.round(F.max("c"), 6).alias("max_complexity"), F.round(F.min("c"), 6).alias("min_complexity"), count(F.col("c") < 0.3).alias("simple"), count((F.col("c") >= 0.3) & (F.col("c") < 0.7)).alias("middling"), count(F.col("c") >= 0.7).alias("complex_"),
    )
    return told.crossJoin(top)


@query("evt06_peak_times", "WITH h AS (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1), w AS (SELECT isodow(ts) - 1 AS w, count(*) AS n FROM events GROUP BY 1) SELECT (SELECT h FROM h ORDER BY n DESC, h LIMIT 1) AS peak_hour, (SELECT w FROM w ORDER BY n DESC, w LIMIT 1) AS peak_day, (SELECT string_agg(h || ':' || n, ',' ORDER BY h) FROM h) AS hours, (SELECT string_agg(w || ':' || n, ',' ORDER BY w) FROM w) AS days")
def peak_times(spark, d):
    def told(part, peak, name):
        c = table(spark, d, "events").groupBy(part.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat_ws(":", x["k"].cast("string"), x["n"].cast("string"))), ",")
        return c.agg(F.min(F.struct((-F.col("n")).alias("n"), "k"))["k"].alias(peak), listed.alias(name))

    return told(F.hour("ts"), "peak_hour", "hours").crossJoin(told(F.weekday("ts"), "peak_day", "days"))


@query("evt34_risk_scores", "WITH u AS (SELECT user_id, count(*) FILTER (event_type='error' AND value >= 20) f, count(*) FILTER (value > 45) s, count(*) n FROM events GROUP BY 1) SELECT user_id, f AS failed, s AS suspicious, n AS events, least(100, CASE WHEN f>10 THEN 30 WHEN f>5 THEN 20 WHEN f>0 THEN 10 ELSE 0 END + CASE WHEN s>5 THEN 40 WHEN s>2 THEN 25 WHEN s>0 THEN 15 ELSE 0 END) AS risk FROM u")
def risk_scores(spark, d):
    """Errors of some weight as failed logins, very large values as suspicious."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.when((F.col("event_type") == "error") & (F.col("value") >= 20), 1)).alias("failed"), F.count(F.when(F.col("value") > 45, 1)).alias("suspicious"), F.count(F.lit(1)).alias("events"))
    return u.withColumn("risk", RP.risk(F.col("failed"), F.col("suspicious")))


_TIER = "CASE n_regionkey WHEN 0 THEN 'free' WHEN 1 THEN 'basic' WHEN 2 THEN 'premium' ELSE 'enterprise' END"
#: Operations a month that each tier may make.
LIMITS = {"free": 1, "basic": 2, "premium": 4, "enterprise": 8}


def _tenants(spark, d) -> DataFrame:
    region = F.col("n_regionkey")
    tier = F.when(region == 0, "free").when(region == 1, "basic").when(region == 2, "premium").otherwise("enterprise")
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_nationkey").alias("tenant"), tier.alias("tier"))


_LIMIT = "CASE " + _TIER + " " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in LIMITS.items()) + " END"


@query("evt36_reservations", f"""
WITH o AS (SELECT o_orderkey, n_nationkey AS tenant, date_trunc('month', o_orderdate) AS month, o_orderdate, {_LIMIT} AS "limit" FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
 r AS (SELECT *, row_number() OVER (PARTITION BY tenant, month ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM o)
SELECT o_orderkey, tenant, i < "limit" AS allowed, least(i, "limit") AS usage, CASE WHEN i >= "limit" THEN 'limit_exceeded: queries ' || least(i, "limit") || ' of ' || "limit" END AS audit FROM r""")
def reservations(spark, d):
    """Orders as operations against their tenant's monthly limit by tier; what is refused leaves an audit row."""
    limit = F.element_at(F.create_map(*[x for t, n in LIMITS.items() for x in (F.lit(t), F.lit(n))]), F.col("tier")).cast("long")
    o = table(spark, d, "orders").join(_tenants(spark, d), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "tenant", F.trunc(F.to_date("o_orderdate"), "month").alias("month"), "o_orderdate", limit.alias("limit"))
    told = RP.reserved(o, ["tenant", "month"], ["o_orderdate", "o_orderkey"], "limit")
    audit = F.when(~F.col("allowed"), F.concat(F.lit("limit_exceeded: queries "), F.col("usage").cast("string"), F.lit(" of "), F.col("limit").cast("string")))
    return told.select("o_orderkey", "tenant", "allowed", "usage", audit.alias("audit"))


POLICIES = [
    RP.Policy("night", 5, ("time_based",), ("query_modification",), {"allowed_hours": [0, 1, 2, 3, 4, 5], "query_prefix": "batch"}),
    RP.Policy("paying", 9, ("tier_based",), ("query_modification", "logging"), {"required_tier": "premium", "query_suffix": "in full"}),
    RP.Policy("short", 7, ("query_length", "tier_based"), ("logging",), {"max_query_length": 18, "required_tier": "basic"}),
    RP.Policy("off", 8, (), ("query_modification",), {"query_prefix": "never"}, active=False),
]


@query("evt37_policy_engine", f"""
WITH e AS (SELECT event_id, hour(ts) AS h, event_type || ' ' || props AS q, {_TIER} AS tier FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey),
 a AS (SELECT *, tier IN ('premium', 'enterprise') AS p1 FROM e), b AS (SELECT *, CASE WHEN p1 THEN q || ' in full' ELSE q END AS q1 FROM a),
 c AS (SELECT *, length(q1) <= 18 AND tier <> 'free' AS p2, h < 6 AS p3 FROM b)
SELECT event_id, CASE WHEN p3 THEN 'batch ' || q1 ELSE q1 END AS query, array_to_string(list_filter([CASE WHEN p1 THEN 'paying' END, CASE WHEN p2 THEN 'short' END, CASE WHEN p3 THEN 'night' END], lambda x: x IS NOT NULL), ',') AS applied FROM c""")
def policy_engine(spark, d):
    """Events as queries of their user's tenant, rewritten by policies of time, length and tier."""
    e = table(spark, d, "events").join(_tenants(spark, d), F.col("user_id") == F.col("c_custkey")).select("event_id", F.hour("ts").alias("hour"), F.concat_ws(" ", "event_type", "props").alias("query"), "tier")
    return RP.with_policies(e, "query", "hour", "tier", POLICIES).select("event_id", "query", F.array_join("applied", ",").alias("applied"))


#: What a service would log of each kind of event.
SAID = {"error": "query timed out after {} seconds", "view": "cache miss, memory usage percent {}", "signup": "auth failed: invalid token, access denied {}", "purchase": "rate limit exceeded {}", "click": "suspicious click {}"}
_MESSAGE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN replace('{m}', '{{}}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR))" for k, m in SAID.items()) + " END"
_LEVEL = "CASE WHEN event_type = 'error' AND value > 30 THEN 'CRITICAL' WHEN event_type IN ('error', 'signup') THEN 'ERROR' WHEN event_type = 'purchase' THEN 'WARNING' ELSE 'INFO' END"
_LOG = f"SELECT event_id, ts, value, {_LEVEL} AS level, {_MESSAGE} AS message FROM events"


def log(spark, d) -> DataFrame:
    kind = F.col("event_type")
    message = reduce(lambda out, k: out.when(kind == k, F.replace(F.lit(SAID[k]), F.lit("{}"), F.floor("value").cast("string"))), list(SAID)[1:], F.when(kind == "error", F.replace(F.lit(SAID["error"]), F.lit("{}"), F.floor("value").cast("string"))))
    level = F.when((kind == "error") & (F.col("value") > 30), "CRITICAL").when(kind.isin("error", "signup"), "ERROR").when(kind == "purchase", "WARNING").otherwise("INFO")
    return table(spark, d, "events").select("event_id", "ts", "value", level.alias("level"), message.alias("message"))


_CLASSES = " UNION ALL ".join(f"SELECT '{g}' AS kind, '{n}' AS class, event_id, level, message FROM l WHERE regexp_matches(message, {_Q(p)}, 'i')" for n, (g, p) in RP.LOG_CLASSES.items())


@query("fun18_log_classes", f"WITH l AS ({_LOG}), c AS ({_CLASSES}) SELECT class, count(*) AS n FROM c GROUP BY 1")
def log_classes(spark, d):
    return log(spark, d).select(F.explode(RP.log_classes(F.col("message"))).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("evt39_log_analytics", f"""
WITH l AS ({_LOG}), c AS ({_CLASSES}), hs AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM l GROUP BY 1),
 tr AS (SELECT avg(n) FILTER (b <= 3) AS recent, avg(n) FILTER (a <= 3) AS early, count(*) AS hours FROM (SELECT n, row_number() OVER (ORDER BY h) AS a, row_number() OVER (ORDER BY h DESC) AS b FROM hs)),
 tm AS (SELECT CAST(unnest(regexp_extract_all(message, '\\d+\\.?\\d*')) AS DOUBLE) AS x FROM c WHERE kind = 'performance')
SELECT (SELECT count(*) FROM l) AS entries, (SELECT round(100.0 * count(*) FILTER (level IN ('ERROR', 'CRITICAL')) / count(*), 2) FROM l) AS error_rate, (SELECT count(*) FROM l WHERE level = 'CRITICAL') AS critical_errors, (SELECT count(*) FROM c WHERE kind = 'error' AND level IN ('ERROR', 'CRITICAL')) AS error_matches,
 (SELECT count(*) FROM c WHERE kind = 'performance') AS performance_events, (SELECT round(avg(x), 6) FROM tm) AS avg_timing, (SELECT max(x) FROM tm) AS max_timing, (SELECT min(x) FROM tm) AS min_timing, (SELECT count(*) FROM c WHERE kind = 'security') AS security_events,
 (SELECT CASE WHEN hours < 2 THEN 'insufficient_data' WHEN recent > early * 1.1 THEN 'increasing' WHEN recent < early * 0.9 THEN 'decreasing' ELSE 'stable' END FROM tr) AS trend, (SELECT h FROM hs ORDER BY n DESC, h LIMIT 1) AS peak_hour""")
def log_analytics(spark, d):
    """Levels, classes, timings and the trend of the hours, in one pass over the lines each."""
    logged = log(spark, d).withColumn("classes", RP.log_classes(F.col("message")))
    of = lambda kind: F.size(F.filter("classes", lambda c: c.isin(*[n for n, (g, _) in RP.LOG_CLASSES.items() if g == kind])))
    bad = F.col("level").isin("ERROR", "CRITICAL")
    numbers = F.transform(F.regexp_extract_all("message", F.lit(r"\d+\.?\d*"), F.lit(0)), lambda x: x.cast("double"))
    summed = F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x)
    slow = of("performance")
    told = logged.agg(
        F.count(F.lit(1)).alias("entries"), F.round(100.0 * F.count(F.when(bad, 1)) / F.count(F.lit(1)), 2).alias("error_rate"), F.count(F.when(F.col("level") == "CRITICAL", 1)).alias("critical_errors"), F.sum(F.when(bad, of("error")).otherwise(0)).alias("error_matches"),
        F.sum(slow).alias("performance_events"), F.round(F.sum(summed * slow) / F.sum(F.size(numbers) * slow), 6).alias("avg_timing"), F.max(F.when(slow > 0, F.array_max(numbers))).alias("max_timing"), F.min(F.when(slow > 0, F.array_min(numbers))).alias("min_timing"), F.sum(of("security")).alias("security_events"),
    )
    hours = logged.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda order: hours.orderBy(order).limit(3).agg(F.avg("n").alias("m"))
    trend = side(F.desc("h")).withColumnRenamed("m", "recent").crossJoin(side(F.asc("h")).withColumnRenamed("m", "early")).crossJoin(hours.agg(F.count(F.lit(1)).alias("hours"), F.min(F.struct((-F.col("n")).alias("n"), "h"))["h"].alias("peak_hour")))
    named = F.when(F.col("hours") < 2, "insufficient_data").when(F.col("recent") > F.col("early") * 1.1, "increasing").when(F.col("recent") < F.col("early") * 0.9, "decreasing").otherwise("stable")
    return told.crossJoin(trend).withColumn("trend", named).drop("recent", "early", "hours").withColumn("peak_hour", F.col("peak_hour").cast("timestamp_ntz"))


@query("evt39_top_errors", f"WITH l AS ({_LOG}) SELECT substr(message, 1, 200) AS message, count(*) AS n FROM l WHERE level IN ('ERROR', 'CRITICAL') GROUP BY 1 ORDER BY n DESC, message LIMIT 10")
def top_errors(spark, d):
    return log(spark, d).filter("level IN ('ERROR', 'CRITICAL')").groupBy(F.substring("message", 1, 200).alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(10)


@query("evt41_eight_kpis", """
WITH e AS (SELECT *, max(ts) OVER () AS now FROM events), r AS (SELECT * FROM e WHERE ts > now - INTERVAL 24 HOUR), h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n, count(DISTINCT user_id) AS u FROM r GROUP BY 1)
SELECT round(avg(value), 6) AS avg_response_time, count(*) AS total_requests, round(avg(CAST(event_type = 'error' AS INT)), 6) AS error_rate, (SELECT round(avg(n), 6) FROM h) AS throughput, (SELECT max(u) FROM h) AS active_users, count(*) FILTER (event_type = 'purchase') AS documents_processed, round(avg(CAST(event_type = 'view' AS INT)) FILTER (event_type IN ('view', 'click')), 6) AS cache_hit_rate, round(avg(value) FILTER (event_type = 'click'), 6) AS memory_usage FROM r""")
def eight_kpis(spark, d):
    """Of the last day: views are what the cache answered, clicks what it didn't."""
    e = table(spark, d, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    r = e.crossJoin(last).filter("ts > since")
    of = lambda *kinds: F.col("event_type").isin(*kinds)
    told = r.agg(F.round(F.avg("value"), 6).alias("avg_response_time"), F.count(F.lit(1)).alias("total_requests"), F.round(F.avg(of("error").cast("int")), 6).alias("error_rate"), F.count(F.when(of("purchase"), 1)).alias("documents_processed"), F.round(F.avg(F.when(of("view", "click"), of("view").cast("int"))), 6).alias("cache_hit_rate"), F.round(F.avg(F.when(of("click"), F.col("value"))), 6).alias("memory_usage"))
    hours = r.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"))
    return told.crossJoin(hours.agg(F.round(F.avg("n"), 6).alias("throughput"), F.max("u").alias("active_users")))


@query("evt42_recent_activity", """
WITH e AS (SELECT *, max(ts) OVER () AS now FROM events), u AS (SELECT user_id, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts))) / 6e7 AS minutes FROM e WHERE ts >= now - INTERVAL 7 DAY GROUP BY 1),
 a AS (SELECT event_type, count(*) AS n FROM e WHERE ts >= now - INTERVAL 7 DAY GROUP BY 1)
SELECT count(*) AS total_users, sum(n) AS total_activities, round(sum(n) / count(*), 2) AS avg_activities, round(avg(minutes), 2) AS avg_minutes, (SELECT string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) FROM (SELECT * FROM a ORDER BY n DESC, event_type LIMIT 5)) AS top_activities FROM u""")
def recent_activity(spark, d):
    e = table(spark, d, "events")
    r = e.crossJoin(e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))).filter("ts >= since")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    users = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ((F.max(at) - F.min(at)) / 6e7).alias("minutes"))
    kinds = r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(5)
    listed = kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))), lambda x: F.concat_ws(":", x["event_type"], (-x["n"]).cast("string"))), ",").alias("top_activities"))
    return users.agg(F.count(F.lit(1)).alias("total_users"), F.sum("n").alias("total_activities"), F.round(F.sum("n") / F.count(F.lit(1)), 2).alias("avg_activities"), F.round(F.avg("minutes"), 2).alias("avg_minutes")).crossJoin(listed)


@query("evt43_metric_status", """
WITH h AS (SELECT user_id, 100.0 * avg(CAST(event_type = 'error' AS INT)) AS error_rate, 100.0 * count(*) FILTER (event_type = 'view') / greatest(1, count(*) FILTER (event_type IN ('view', 'click'))) AS cache_hit_rate, least(100, 4 * avg(value)) AS memory_usage, least(100, 2 * max(value)) AS cpu_usage, avg(value) AS throughput FROM events GROUP BY 1),
 m AS (UNPIVOT h ON error_rate, cache_hit_rate, memory_usage, cpu_usage, throughput INTO NAME metric VALUE v)
SELECT user_id, metric, round(v, 6) AS value, CASE metric WHEN 'throughput' THEN 'healthy' WHEN 'cache_hit_rate' THEN CASE WHEN v < 50 THEN 'critical' WHEN v < 70 THEN 'warning' ELSE 'healthy' END
 WHEN 'error_rate' THEN CASE WHEN v > 10 THEN 'critical' WHEN v > 5 THEN 'warning' ELSE 'healthy' END WHEN 'memory_usage' THEN CASE WHEN v > 90 THEN 'critical' WHEN v > 80 THEN 'warning' ELSE 'healthy' END ELSE CASE WHEN v > 85 THEN 'critical' WHEN v > 70 THEN 'warning' ELSE 'healthy' END END AS status FROM m""")
def metric_status(spark, d):
    """Each metric by its own thresholds."""
    of = lambda *kinds: F.col("event_type").isin(*kinds)
    n = lambda *kinds: F.count(F.when(of(*kinds), 1))
    metrics = {"error_rate": 100.0 * F.avg(of("error").cast("int")), "cache_hit_rate": 100.0 * n("view") / F.greatest(F.lit(1), n("view", "click")), "memory_usage": F.least(F.lit(100.0), 4 * F.avg("value")), "cpu_usage": F.least(F.lit(100.0), 2 * F.max("value")), "throughput": F.avg("value")}
    h = table(spark, d, "events").groupBy("user_id").agg(*[c.alias(k) for k, c in metrics.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(k, 6).alias("value"), RP.metric_status(k, F.col(k)).alias("status")) for k in metrics])
    return h.select("user_id", F.inline(rows))


@query("fun13_financial_figures", f"""
SELECT doc_id, len(regexp_extract_all(text, {_Q(RP.CURRENCY)})) AS currencies, len(regexp_extract_all(text, '\\d+(?:\\.\\d+)?\\s*%')) AS percentages, len(regexp_extract_all(text, '\\d{{1,3}}(?:,\\d{{3}})*(?:\\.\\d+)?')) AS numbers,
 {' + '.join(f"len(regexp_extract_all(text, '(?i){i}[:\\s]+\\d+(?:\\.\\d+)?'))" for i in RP.ECONOMIC)} AS indicators, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(text), {_Q(t.lower())}) THEN {_Q(t)} END" for t in RP.TERMS)}], lambda x: x IS NOT NULL), ',') AS terms FROM documents""")
def financial_figures(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    terms = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lit(t.lower())), t) for t in RP.TERMS]))
    indicators = reduce(lambda a, b: a + b, [n(rf"(?i){i}[:\s]+\d+(?:\.\d+)?") for i in RP.ECONOMIC])
    return table(spark, d, "documents").select("doc_id", n(RP.CURRENCY).alias("currencies"), n(r"\d+(?:\.\d+)?\s*%").alias("percentages"), n(r"\d{1,3}(?:,\d{3})*(?:\.\d+)?").alias("numbers"), indicators.alias("indicators"), F.array_join(terms, ",").alias("terms"))


#: Banned words of the query check, of our own choice; share of errors that makes a history.
BANNED = ["idiot", "worthless", "password"]


@query("fun15_threat_scores", f"""
WITH h AS (SELECT source, avg(CAST(toxic AS DOUBLE)) AS history FROM documents JOIN labels USING (doc_id) GROUP BY 1),
 s AS (SELECT doc_id, CASE WHEN length(text) > 1000 THEN 0.3 ELSE 0 END + {' + '.join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.5 ELSE 0 END" for w in BANNED)} + {' + '.join(f"CASE WHEN regexp_matches(text, {_Q('(?i)' + p)}) THEN 0.4 ELSE 0 END" for p in RP.SUSPECT)} + 0.2 * coalesce(history, 0) AS s FROM documents LEFT JOIN h USING (source))
SELECT doc_id, round(s, 6) AS score, s > 0.3 AS suspicious, s > 0.6 AS blocked FROM s""")
def threat_scores(spark, d):
    """Texts as queries; a source's share of labelled toxic texts is its history."""
    docs = table(spark, d, "documents")
    history = docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.avg(F.col("toxic").cast("double")).alias("history"))
    told = RP.threat(F.col("text"), BANNED, F.coalesce("history", F.lit(0.0)))
    return docs.join(history, "source", "left").select("doc_id", F.round(told["score"], 6).alias("score"), told["suspicious"].alias("suspicious"), told["blocked"].alias("blocked"))


_TURNS = "SELECT a.conv_id, a.turn, a.text AS answer, [ 'what about ', 'explain ', '' ][a.conv_id % 3 + 1] || q.text AS question FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 AND q.role = 'user' WHERE a.role = 'assistant'"


def turns(spark, d) -> DataFrame:
    """Answers with the question before them, each asked in one of three ways."""
    c = table(spark, d, "conversations")
    q = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    way = F.when(F.col("conv_id") % 3 == 0, "what about ").when(F.col("conv_id") % 3 == 1, "explain ").otherwise("")
    return c.filter("role = 'assistant'").join(q, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").alias("answer"), F.concat(way, "question").alias("question"))


@query("fun24_25_answer_scores", f"""
WITH t AS ({_TURNS}), w AS (SELECT *, {_W.format('lower(question)')} AS qs, string_split(answer, '.') AS ss FROM t)
SELECT conv_id, turn, round(CASE WHEN answer = '' OR question = '' THEN 0 ELSE least(len({_W.format('answer')}) / CASE WHEN list_has_any(qs, ['what', 'how', 'why', 'when', 'where', 'who']) THEN 50 WHEN list_has_any(qs, ['explain', 'describe', 'tell']) THEN 100 ELSE 30 END, 1.0) END, 6) AS completeness,
 round(CASE WHEN answer = '' THEN 0 ELSE 0.6 * least(({' + '.join(f"CAST(contains(lower(answer), '{i}') AS INT)" for i in RP.INDICATORS)}) / 5, 1.0) + 0.4 * least(list_sum(list_transform(ss, lambda s: len({_W.format('s')}))) / len(ss) / 20, 1.0) END, 6) AS coherence FROM w""")
def answer_scores(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.round(RP.completeness(F.col("answer"), F.col("question")), 6).alias("completeness"), F.round(RP.coherence(F.col("answer")), 6).alias("coherence"))


@query("prj08_prompt_whole_texts", """
WITH n AS (SELECT source, doc_id, trim(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents), p AS (SELECT *, 'Source ' || i || ' (' || source || '):' || chr(10) AS h FROM n),
 u AS (SELECT *, sum(length(h || t)) OVER (PARTITION BY source ORDER BY i) AS used FROM p), b AS (SELECT *, used - length(h || t) AS before, 8000 - (used - length(h || t)) - 50 AS rest FROM u),
 s AS (SELECT *, CASE WHEN used <= 8000 THEN h || t WHEN before <= 8000 AND rest > 100 THEN h || substr(t, 1, CAST(rest AS BIGINT)) || '...' END AS said FROM b)
SELECT source, md5(string_agg(said, chr(10) || chr(10) ORDER BY i)) AS context FROM s WHERE said IS NOT NULL GROUP BY 1""")
def prompt_whole_texts(spark, d):
    """Each source's texts, whole, while they fit; the first that doesn't is cut."""
    return RP.prompt_context(table(spark, d, "documents").withColumn("origin", F.col("source")), "source", "doc_id", "text", "origin", 8000).withColumn("context", F.md5("context"))


@query("cac10_predictions", """
WITH k AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS seen FROM events GROUP BY 1, 2), m AS (SELECT max(ts) AS now FROM events),
 s AS (SELECT user_id, count(*) FILTER (seen > now - INTERVAL 2 DAY) AS size, count(*) FILTER (seen <= now - INTERVAL 2 DAY) AS evicted, sum(n - 1) AS hits, count(*) AS misses, avg(n) AS mean FROM k, m GROUP BY 1),
 t AS (SELECT *, hits / greatest(1, hits + misses) AS rate FROM s)
SELECT user_id, round(rate, 6) AS hit_rate, CASE WHEN rate > 0.8 THEN 1100 WHEN rate < 0.6 THEN 900 ELSE 1000 END AS optimal_size, CASE WHEN size + evicted < 4 THEN 'lru' WHEN mean > 5 THEN 'lfu' ELSE 'adaptive' END AS strategy,
 round(greatest(0, least(1, 0.5 * rate + 0.3 * size / 5 + 0.2 * (1 - evicted / greatest(1, hits + misses)))), 6) AS score FROM t""")
def cache_predictions(spark, d):
    """A user's kinds of events as a cache of five: what it does, how large it should be, how it should evict."""
    e = table(spark, d, "events")
    k = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("seen")).crossJoin(e.agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("since")))
    count = lambda test: F.count(F.when(test, 1))
    s = k.groupBy("user_id").agg(count(F.col("seen") > F.col("since")).alias("size"), count(F.col("seen") <= F.col("since")).alias("evicted"), F.sum(F.col("n") - 1).alias("hits"), F.count(F.lit(1)).alias("misses"), F.avg("n").alias("mean"))
    total = F.greatest(F.lit(1), F.col("hits") + F.col("misses"))
    s = s.withColumn("rate", F.col("hits") / total)
    size = F.when(F.col("rate") > 0.8, 1100).when(F.col("rate") < 0.6, 900).otherwise(1000)
    how = F.when(F.col("size") + F.col("evicted") < 4, "lru").when(F.col("mean") > 5, "lfu").otherwise("adaptive")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * F.col("rate") + 0.3 * F.col("size") / 5 + 0.2 * (1 - F.col("evicted") / total)))
    return s.select("user_id", F.round("rate", 6).alias("hit_rate"), size.alias("optimal_size"), how.alias("strategy"), F.round(score, 6).alias("score"))


_LEXICAL = f"""w AS (SELECT doc_id, list_distinct({_W.format('lower(text)')}) AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS term FROM w),
 n AS (SELECT q.doc_id AS query_id, b.doc_id AS id, count(*) AS n FROM t q JOIN t b USING (term) WHERE q.doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) GROUP BY 1, 2), l AS (SELECT query_id, id, n FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) <= 20)"""


def lexical(spark, d) -> DataFrame:
    """(query_id, id, score): documents by the share of the query document's words that they hold, twenty a query."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    own = docs.join(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("doc_id")), "doc_id")
    size = own.select(F.col("doc_id").alias("query_id"), F.greatest(F.lit(1), F.size(F.array_distinct(A.word_list(F.lower("text"))))).alias("words"))
    return R.keyword_search(docs, own, "doc_id", "doc_id", "text", 20).join(size, "query_id").select("query_id", "id", (F.col("n") / F.col("words")).alias("score"))


@query("hyb10_score_fusion", f"WITH {_NEAR}, {_LEXICAL}, s AS (SELECT query_id, id, s FROM r WHERE k <= 20), h AS (SELECT query_id, id, n / greatest(1, len(ws)) AS h FROM l JOIN w ON w.doc_id = query_id) SELECT coalesce(s.query_id, h.query_id) AS query_id, coalesce(s.id, h.id) AS id, round(0.7 * coalesce(s, 0) + (1 - 0.7) * coalesce(h, 0), 6) AS score FROM s FULL JOIN h ON s.query_id = h.query_id AND s.id = h.id")
def score_fusion(spark, d):
    """Cosines of the nearest vectors and shares of common words, weighted."""
    e = table(spark, d, "embeddings")
    s = V.batch_topk(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 20).select("query_id", "id", F.col("score").alias("cosine"))
    return R.fuse_scores(s, lexical(spark, d).withColumnRenamed("score", "hits"), 0.7, ["query_id", "id"]).select("query_id", "id", F.round("score", 6).alias("score"))


@query("udf01_eight_hooks", "SELECT lang, count(*) AS n, sum(length(text)) AS chars, 'on_error,post_query,pre_query,pre_response' AS failed FROM documents WHERE n_chars > 100 GROUP BY 1")
def eight_hooks(spark, d):
    """Hooks of all kinds along a pipeline; some fail, by a column that isn't there, by what they lose, by an exception."""
    hooks = RP.Hooks()
    hooks.register("pre_document_ingest", lambda df: df.filter("n_chars > 100"))
    hooks.register("post_document_ingest", lambda df: df.withColumn("chars", F.length("text")))
    hooks.register("pre_query", lambda df: df.select("no_such_column"))
    hooks.register("post_query", lambda df: df.drop("chars"))
    hooks.register("pre_response", lambda df: [][1])
    hooks.register("post_response", lambda df: df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")))
    hooks.register("on_user_interaction", lambda df: df.filter("n > 0"))
    hooks.register("on_error", lambda df: df.select("neither"))
    df = table(spark, d, "documents")
    for kind in RP.HOOKS[:6]:
        df = hooks.run(kind, df, ["chars"] if kind in ("pre_query", "post_query", "pre_response") else [])
    df = hooks.run("on_user_interaction", df)
    return df.withColumn("failed", F.lit(",".join(sorted({k for k, _ in hooks.failed}))))


@query("snk08_chunks_stored", """
WITH c AS (SELECT doc_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n, lang FROM documents), k AS (SELECT doc_id, lang, CASE WHEN n <= 358 THEN 1 ELSE 1 + CAST(ceil((n - 358) / 308) AS BIGINT) END AS chunks FROM c)
SELECT lang, CASE WHEN lang = 'en' THEN 'prose' ELSE 'text' END AS chunk_type, lang = 'de' AS is_semantic, sum(chunks) AS chunks, count(*) AS docs FROM k GROUP BY 1""")
def chunks_stored(spark, d):
    """Documents cut, each chunk with its metadata and their defaults, stored and read back."""
    docs = table(spark, d, "documents")
    given = F.map_filter(F.create_map(F.lit("chunk_type"), F.when(F.col("lang") == "en", "prose"), F.lit("is_semantic"), F.when(F.col("lang") == "de", "true")), lambda k, v: v.isNotNull())
    cut = docs.withColumn("m", given).select("doc_id", "lang", "m", F.posexplode(C.token_chunks(F.col("text"))).alias("chunk", "content"))
    rows = T.chunk_rows(cut, "content", "m").drop("m").withColumn("chunk_id", C.chunk_id(F.col("doc_id"), F.col("chunk"), C.SIZE, C.OVERLAP))
    folder = VS.new_store(spark)
    VS.write(rows, folder, "chunks")
    held = VS.read(spark, folder).filter("chunk_length = length(content)")
    return held.groupBy("lang", "chunk_type", "is_semantic").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("doc_id").alias("docs"))


_BANDS = f"""WITH RECURSIVE {_SESSIONS}, s AS (SELECT user_id, start, (max(t) - start) / 1e6 AS seconds FROM al GROUP BY 1, 2)
SELECT CASE WHEN seconds < 300 THEN 'short' WHEN seconds < 1800 THEN 'medium' ELSE 'long' END AS band, count(*) AS n, round(avg(seconds), 3) AS mean, round(stddev_pop(seconds), 3) AS std FROM s GROUP BY 1"""


@query("evt15_session_lengths", _BANDS)
def session_lengths(spark, d):
    s = SC.sessions(table(spark, d, "events"), "user_id", "ts").withColumn("seconds", (F.col("last") - F.col("start")) / 1e6)
    band = F.when(F.col("seconds") < 300, "short").when(F.col("seconds") < 1800, "medium").otherwise("long")
    return s.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 3).alias("mean"), F.round(F.stddev_pop("seconds"), 3).alias("std"))


#: Runs of one character four times and more, from all characters, as the other engine's patterns have no references.
_RUNS = """ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM documents), rn AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM ch WHERE c <> chr(10)),
 rr AS (SELECT doc_id, count(*) AS runs FROM (SELECT doc_id FROM rn GROUP BY doc_id, c, g HAVING count(*) >= 4) GROUP BY 1)"""


@query("fun04_07_content_class", f"""
WITH {_RUNS}, s AS (SELECT doc_id, text, least(1.0, 0.2 * (len(regexp_extract_all(text, 'https?://\\S+')) + len(regexp_extract_all(text, '@')) + len(regexp_extract_all(text, '#')) + len(regexp_extract_all(text, '\\$')) + len(regexp_extract_all(text, '[A-Z]{{3,}}'))) + 0.3 * coalesce(runs, 0) + CASE WHEN length(text) > 500 THEN 0.2 ELSE 0 END) AS spam,
 least(1.0, 0.3 * (len(regexp_extract_all(text, '[0-9]{{4,}}')) + len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}')) + len(regexp_extract_all(text, '\\+[1-9][0-9]{{6,14}}')))) AS personal,
 {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in X.TOXIC)} AS toxic, {' + '.join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in X.SENSITIVE)} AS sensitive FROM documents LEFT JOIN rr USING (doc_id))
SELECT doc_id, CASE WHEN toxic > 0 THEN 'toxic' WHEN spam > 0.5 THEN 'spam' WHEN sensitive > 0 THEN 'sensitive' WHEN personal > 0.5 THEN 'inappropriate' ELSE 'safe' END AS content_class, round(spam, 6) AS spam, round(least(sensitive / 2, 1.0), 6) AS sensitivity FROM s""")
def content_class(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.content_class(t).alias("content_class"), F.round(X.spam_score(t), 6).alias("spam"), F.round(F.least(X.held(t, X.SENSITIVE) / 2, F.lit(1.0)), 6).alias("sensitivity"))


_HEADS = "CASE " + " ".join(f"WHEN starts_with(lower(trim(text)), '{h}') THEN [{', '.join(f'{_Q(p + chr(32))} || lower(trim(text))' for p in ps)}]" for h, ps in R.QUESTION_HEADS.items()) + " ELSE ['Information about ' || lower(trim(text)), 'Details of ' || lower(trim(text)), 'Overview of ' || lower(trim(text))] END"
_VARIANTS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{h}') THEN replace(lower(text), '{h}', '{o}') END" for h, os in R.SYNONYMS.items() for o in os) + "], lambda x: x IS NOT NULL)[1:3]"


@query("exp01_08_expansion", f"WITH a AS (SELECT item_id, text, list_concat([text], {_VARIANTS}, {_HEADS}) AS v FROM benchmark), b AS (SELECT item_id, CASE WHEN length(trim(text)) < 3 THEN [text] ELSE {_ONCE.format('v')}[1:4] END AS v FROM a) SELECT item_id, unnest(range(0, len(v))) AS position, unnest(v) AS variant FROM b")
def expansion(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(R.expand(F.col("text"))).alias("position", "variant"))


# --- pages: what their markup says, whole ---------------------------------------------------------------------------

_PLAIN = lambda c: f"trim(replace(replace(replace(replace(replace(replace({c},'&lt;','<'),'&gt;','>'),'&quot;','\"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&'))"
_META = lambda key, name: _PLAIN(f"regexp_extract(html, '(?is)<meta\\s+{key}=\"{name}\"\\s+content=\"([^\"]*)\"', 1)")


@query("src07_page_metadata", f"""SELECT page_id, regexp_extract(html, '(?is)<html[^>]*\\blang="([^"]*)"', 1) AS lang, {_PLAIN("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_META('name', 'description')} AS description, {_META('name', 'keywords')} AS keywords,
 regexp_extract(html, '(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical, {_META('property', 'og:title')} AS og_title, {_META('property', 'og:description')} AS og_description, {_META('property', 'og:url')} AS og_url FROM pages""")
def page_metadata(spark, d):
    html = F.col("html")
    meta = lambda key, name: F.trim(H.unescape(F.regexp_extract(html, rf'(?is)<meta\s+{key}="{name}"\s+content="([^"]*)"', 1)))
    return table(spark, d, "pages").select(
        "page_id", H.language(html).alias("lang"), H.title(html).alias("title"), meta("name", "description").alias("description"), meta("name", "keywords").alias("keywords"),
        F.regexp_extract(html, r'(?is)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1).alias("canonical"), *[meta("property", f"og:{n}").alias(f"og_{n}") for n in ("title", "description", "url")],
    )


@query("src08_all_headings", "WITH h AS (" + " UNION ALL ".join(f"SELECT page_id, {n} AS level, unnest(regexp_extract_all(html, '(?is)<h{n}[^>]*>(.*?)</h{n}>', 1)) AS t, unnest(range(len(regexp_extract_all(html, '(?is)<h{n}[^>]*>(.*?)</h{n}>', 1)))) AS i FROM pages" for n in range(1, 7)) + "), p AS (SELECT page_id, level, i, trim(ltrim(regexp_replace(trim(t), '<[^>]+>', '', 'g'), '# ')) AS t FROM h) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY level, i) - 1 AS position, level, md5(t) AS text FROM p WHERE t <> ''")
def all_headings(spark, d):
    """Headings of all levels, level by level, without marks before them; empty ones go."""
    told = F.filter(F.transform(H.headings(F.col("html")), lambda h: F.struct(h["level"].alias("level"), F.trim(F.regexp_replace(h["text"], "^[# ]+", "")).alias("text"))), lambda h: h["text"] != "")
    return table(spark, d, "pages").select("page_id", F.posexplode(told).alias("position", "h")).select("page_id", "position", "h.level", F.md5("h.text").alias("text"))


@query("src12_marked_headings", "WITH a AS (SELECT page_id, html AS t FROM pages), " + ", ".join(f"{chr(97 + n)} AS (SELECT page_id, regexp_replace(t, '(?is)<h{n}[^>]*>(.*?)</h{n}>', chr(10) || '{'#' * n} \\1' || chr(10), 'g') AS t FROM {chr(96 + n)})" for n in range(1, 7)) + " SELECT page_id, md5(t) AS html FROM g")
def marked_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(H.marked_headings(F.col("html"))).alias("html"))


@query("src15_markdown_figures", """
WITH d AS (SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<h1[^>]*>(.*?)</h1>', chr(10) || '# \\1' || chr(10), 'g'), '(?is)<h2[^>]*>(.*?)</h2>', chr(10) || '## \\1' || chr(10), 'g'), '(?is)<li[^>]*>(.*?)</li>', chr(10) || '- \\1' || chr(10), 'g'), '(?is)<a\\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>', '[\\2](\\1)', 'g'), '(?is)<img\\s[^>]*src="([^"]+)"[^>]*>', '![x](\\1)', 'g') AS t FROM pages)
SELECT id AS page_id, len(regexp_extract_all(t, '(?m)^#{1,6}\\s+\\S')) AS headings, len(regexp_extract_all(t, '\\[[^\\]]*\\]\\([^)]+\\)')) AS links, len(regexp_extract_all(t, '!\\[[^\\]]*\\]\\([^)]+\\)')) AS images, len(regexp_extract_all(t, '(?m)^\\s*[-*+]\\s+')) AS bullets, len(regexp_extract_all(t, '(?m)^\\s*[0-9]+\\.\\s+')) AS numbers, len(regexp_extract_all(t, '(?m)^>\\s?')) AS quotes, len(regexp_extract_all(t, '(?m)^\\|.*\\|\\s*$')) AS table_rows, len(regexp_extract_all(t, '(?m)^```')) // 2 AS code_blocks FROM d""")
def markdown_figures(spark, d):
    """Pages written as Markdown, and all that is counted in it."""
    t = F.col("html")
    for pattern, other in ((r"(?is)<h1[^>]*>(.*?)</h1>", "\n# $1\n"), (r"(?is)<h2[^>]*>(.*?)</h2>", "\n## $1\n"), (r"(?is)<li[^>]*>(.*?)</li>", "\n- $1\n"), (r'(?is)<a\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>', "[$2]($1)"), (r'(?is)<img\s[^>]*src="([^"]+)"[^>]*>', "![x]($1)")):
        t = F.regexp_replace(t, pattern, other)
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in H.markdown_metadata(t).items()])


@query("src19_sheets", """
WITH r AS (SELECT o_orderkey // 100 AS sheet, o_orderkey AS i, list_filter(['o_custkey=' || o_custkey, CASE WHEN o_orderstatus <> 'F' THEN 'o_orderstatus=' || o_orderstatus END, 'o_orderdate=' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')], lambda x: x IS NOT NULL) AS vs FROM orders)
SELECT sheet, md5('Sheet: ' || sheet || chr(10) || 'Columns: o_custkey, o_orderstatus, o_orderdate' || chr(10) || string_agg('row ' || i || ': ' || array_to_string(vs, ', '), chr(10) ORDER BY i)) AS text FROM r GROUP BY 1""")
def sheets(spark, d):
    """Orders by hundreds as sheets: name, header, and each row with its values; missing ones go, dates in ISO form."""
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 100).alias("sheet"), "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("o_orderstatus"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("o_orderdate"))
    columns = ["o_custkey", "o_orderstatus", "o_orderdate"]
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")
    told = o.withColumn("line", H.row_text(columns, F.col("o_orderkey"))).groupBy("sheet").agg(rows.alias("rows"))
    return told.select("sheet", F.md5(F.concat(F.lit("Sheet: "), F.col("sheet").cast("string"), F.lit(f"\nColumns: {', '.join(columns)}\n"), "rows")).alias("text"))


# --- ids, batches, files, months, levels of a cache, expanded search ------------------------------------------------


@query("chk02_id_chunks")
def id_chunks(spark, d):
    """Windows of ids of a public vocabulary; its files are named by their package."""
    import public_tokenizers

    return C.id_chunks(table(spark, d, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumn("content", F.md5("content"))


@query("udf03_batched_map", "WITH r AS (SELECT event_id, CAST(regexp_extract(props, '\\{\"k\": (\\d+)\\}', 1) AS BIGINT) AS k, (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS batch FROM events) SELECT batch, count(*) AS n, count(*) FILTER (k % 7 <> 0) AS done, sum(CASE WHEN k % 7 <> 0 THEN 1000 // k END) AS total FROM r GROUP BY 1")
def batched_map(spark, d):
    """Events in batches by time, each through a Python function that fails on some; these go."""
    import json

    def share(props: str) -> int:
        k = json.loads(props)["k"]
        return 1000 // (k if k % 7 else 0)

    held = D.in_batches(table(spark, d, "events"), ["ts", "event_id"], 500)
    done = D.mapped(held.select("batch", "event_id", "props"), "props", share, "long").groupBy("batch").agg(F.count(F.lit(1)).alias("done"), F.sum("mapped").alias("total"))
    return held.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).join(done, "batch", "left")


_NAME = "CASE doc_id % 5 WHEN 0 THEN source || '/' || doc_id || '.pdf' WHEN 1 THEN source || '/' || doc_id || '.docx' WHEN 2 THEN source || '/<script' || doc_id || '.txt' ELSE source || '/' || doc_id || '.txt' END"
_KIND_OF = "CASE WHEN lang = 'en' THEN 'pdf' WHEN lang = 'de' THEN 'docx' ELSE 'text' END"


@query("src26_file_validation", f"""
WITH f AS (SELECT doc_id, {_NAME} AS name, {_KIND_OF} AS kind, CASE WHEN lang = 'en' THEN 'application/pdf' ELSE 'text/plain' END AS mime, strlen(text) AS size FROM documents), e AS (SELECT *, regexp_extract(name, '(\\.[^./]+)$', 1) AS ext FROM f),
 c AS (SELECT *, list_filter([CASE WHEN size > 4000 THEN 'File too large: ' || size || ' bytes (max: 4000 bytes)' END, CASE WHEN kind = 'pdf' AND ext <> '.pdf' THEN 'Invalid PDF file extension: ' || ext END, CASE WHEN kind = 'docx' AND ext <> '.docx' THEN 'Invalid DOCX file extension: ' || ext END], lambda x: x IS NOT NULL) AS es,
  list_filter([CASE WHEN kind NOT IN ('pdf', 'text') THEN 'Source type not explicitly allowed: ' || kind END, CASE WHEN (mime = 'application/pdf' AND ext IN ('.txt', '.docx')) OR (mime = 'text/plain' AND ext IN ('.pdf', '.docx')) THEN 'MIME/extension mismatch: mime=' || mime || ', ext=' || ext END], lambda x: x IS NOT NULL) AS ws, contains(name, '<script') AS odd FROM e)
SELECT doc_id, array_to_string(es, '; ') AS errors, array_to_string(ws, '; ') AS warnings, CASE WHEN odd THEN 'Suspicious filename pattern: <script' ELSE '' END AS issues, len(es) = 0 AND NOT odd AS valid FROM c""")
def file_validation(spark, d):
    """Documents as files of their source, with names and media types that fit or don't."""
    i, lang = F.col("doc_id"), F.col("lang")
    name = lambda before, after: F.concat("source", F.lit(before), i.cast("string"), F.lit(after))
    names = F.when(i % 5 == 0, name("/", ".pdf")).when(i % 5 == 1, name("/", ".docx")).when(i % 5 == 2, name("/<script", ".txt")).otherwise(name("/", ".txt"))
    kind = F.when(lang == "en", "pdf").when(lang == "de", "docx").otherwise("text")
    told = D.validated(names, kind, F.when(lang == "en", "application/pdf").otherwise("text/plain"), F.octet_length("text"), 4000, ["pdf", "text"])
    return table(spark, d, "documents").select("doc_id", *[F.array_join(told[k], "; ").alias(k) for k in ("errors", "warnings", "issues")], told["valid"].alias("valid"))


@query("evt32_monthly_trends", f"""
WITH m AS (SELECT min(o_orderdate) AS since FROM orders), o AS (SELECT n_nationkey AS tenant, {_TIER} AS tier, (epoch_us(o_orderdate) - epoch_us(since)) // 2592000000000 AS month, o_totalprice, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey, m),
 b AS (SELECT tenant, any_value(tier) AS tier, month, count(*) AS queries, avg(CAST(o_orderstatus = 'F' AS INT)) AS done, sum(o_totalprice) / 1e6 AS gb FROM o GROUP BY 1, 3)
SELECT tenant, month, queries, round(done, 6) AS done, round(0.001 * queries + 0.1 * gb + CASE tier WHEN 'free' THEN 0 WHEN 'basic' THEN 10 WHEN 'premium' THEN 50 ELSE 200 END, 4) AS cost, queries - lag(queries) OVER (PARTITION BY tenant ORDER BY month) AS change FROM b""")
def monthly_trends(spark, d):
    """Usage by tenant and thirty days: operations, share done, cost with the tier's base, and the change."""
    orders = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    since = orders.agg(F.min("t").alias("since"))
    o = orders.join(_tenants(spark, d), F.col("o_custkey") == F.col("c_custkey")).crossJoin(since).withColumn("month", F.floor((F.col("t") - F.col("since")) / 2_592_000_000_000))
    b = o.groupBy("tenant", "tier", "month").agg(F.count(F.lit(1)).alias("queries"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("done"), (F.sum("o_totalprice") / 1e6).alias("gb"))
    base = F.when(F.col("tier") == "free", 0).when(F.col("tier") == "basic", 10).when(F.col("tier") == "premium", 50).otherwise(200)
    change = F.col("queries") - F.lag("queries").over(Window.partitionBy("tenant").orderBy("month"))
    return b.select("tenant", "month", "queries", F.round("done", 6).alias("done"), F.round(0.001 * F.col("queries") + 0.1 * F.col("gb") + base, 4).alias("cost"), change.alias("change"))


#: Seconds that the two levels keep an entry.
LEVELS = (6 * 3600, 3 * 86_400)


@query("cac13_two_levels", f"""
WITH RECURSIVE k AS (SELECT DISTINCT user_id, event_type FROM events), e AS (SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS t, false AS mark FROM events UNION ALL SELECT e.event_id, k.user_id, k.event_type, epoch_us(ts), true FROM events e JOIN k ON k.user_id = e.user_id AND k.event_type LIKE 'c%' WHERE e.event_type = 'signup'),
 o AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY t, event_id, mark) AS i FROM e),
 f AS (SELECT user_id, kind, i, CASE WHEN mark THEN 'nothing' ELSE 'miss' END AS level, CASE WHEN mark THEN NULL ELSE t END AS a, CASE WHEN mark THEN NULL ELSE t END AS b FROM o WHERE i = 1
  UNION ALL SELECT user_id, kind, i, level, CASE WHEN mark THEN NULL WHEN level = 'first' THEN a ELSE t END, CASE WHEN mark THEN NULL WHEN level = 'miss' THEN t ELSE b END
  FROM (SELECT o.user_id, o.kind, o.i, o.t, o.mark, f.a, f.b, CASE WHEN mark THEN CASE WHEN coalesce(o.t - a <= {LEVELS[0] * 10**6} OR o.t - b <= {LEVELS[1] * 10**6}, false) THEN 'gone' ELSE 'nothing' END WHEN o.t - a <= {LEVELS[0] * 10**6} THEN 'first' WHEN o.t - b <= {LEVELS[1] * 10**6} THEN 'second' ELSE 'miss' END AS level FROM f JOIN o ON o.user_id = f.user_id AND o.kind = f.kind AND o.i = f.i + 1) g)
SELECT user_id, level, count(*) AS n FROM f GROUP BY 1, 2""")
def two_levels(spark, d):
    """A user's kinds of events as keys; every signup invalidates the user's keys that begin with c."""
    e = table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), "ts", F.lit(False).alias("mark"))
    matched = e.select("user_id", "kind").distinct().filter("kind LIKE 'c%'")
    gone = e.filter("kind = 'signup'").drop("kind").join(matched, "user_id").select("event_id", "user_id", "kind", "ts", F.lit(True).alias("mark"))
    rows = e.unionByName(gone).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "kind"))
    told = SC.scan(rows, "key", "ts", ["event_id", "mark"], SC.TwoLevels(LEVELS[0] * 10**6, LEVELS[1] * 10**6), "string", mark="mark")
    return told.groupBy("user_id", F.col("value").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("hyb17_expanded_pipeline", f"""
WITH x AS (SELECT item_id, unnest(range(0, len(v))) AS position, unnest(v) AS variant FROM (SELECT item_id, CASE WHEN length(trim(text)) < 3 THEN [text] ELSE {_ONCE.format('v')}[1:4] END AS v FROM (SELECT item_id, text, list_concat([text], {_VARIANTS}, {_HEADS}) AS v FROM benchmark WHERE item_id % 10 = 0))),
 q AS (SELECT item_id, position, {_W.format('lower(variant)')} AS ws FROM x), t AS (SELECT item_id, position, unnest(list_distinct(ws)) AS term FROM q), dt AS (SELECT doc_id, unnest(list_distinct({_W.format('lower(text)')})) AS term FROM documents),
 n AS (SELECT item_id, position, doc_id, count(*) AS n FROM t JOIN dt USING (term) GROUP BY 1, 2, 3), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY item_id, position ORDER BY n DESC, doc_id) <= 10),
 s AS (SELECT item_id, doc_id, max(n / greatest(1, len(list_distinct(ws)))) AS s FROM k JOIN q USING (item_id, position) GROUP BY 1, 2),
 m AS (SELECT doc_id, 0.25 * (CASE WHEN n_chars BETWEEN 500 AND 4000 THEN 0.5 ELSE 0.25 END + CASE WHEN lang = 'en' THEN 0.5 ELSE 0.25 END) AS meta FROM documents)
SELECT item_id, doc_id, round(0.75 * s + meta, 6) AS score FROM s JOIN m USING (doc_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(0.75 * s + meta, 6) DESC, doc_id) <= 5""")
def expanded_pipeline(spark, d):
    """Benchmark items expanded, each variant searched for twice as many as asked, hits once, reranked with a quarter of metadata."""
    docs = table(spark, d, "documents")
    variants = table(spark, d, "benchmark").filter("item_id % 10 = 0").select("item_id", F.posexplode(R.expand(F.col("text"))).alias("position", "text")).withColumn("query", F.struct("item_id", "position"))
    size = variants.select("query", F.greatest(F.lit(1), F.size(X.word_set(F.col("text")))).alias("words"))
    found = R.keyword_search(docs, variants, "doc_id", "query", "text", 10).join(size.withColumnRenamed("query", "query_id"), "query_id")
    once = found.groupBy("query_id.item_id", F.col("id").alias("doc_id")).agg(F.max(F.col("n") / F.col("words")).alias("s"))
    meta = F.when(F.col("n_chars").between(500, 4000), 0.5).otherwise(0.25) + F.when(F.col("lang") == "en", 0.5).otherwise(0.25)
    scored = once.join(docs.select("doc_id", (0.25 * meta).alias("meta")), "doc_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"), F.round(0.75 * F.col("s") + F.col("meta"), 6).alias("score"))
    return R.placed(scored, [F.desc("score"), "id"], 5).select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score")


@query("evt19_satisfaction_advice", """
WITH r AS (SELECT event_id, ts, event_type, 1 + least(4, floor(value / 4)) AS s FROM events), o AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM r),
 h AS (SELECT avg(s) AS mean, avg(s) FILTER (i < n // 2) AS early, avg(s) FILTER (i >= n // 2) AS late FROM o), k AS (SELECT event_type, avg(s) AS m FROM r GROUP BY 1)
SELECT round(mean, 6) AS score, CASE WHEN mean >= 4 THEN 'excellent' WHEN mean >= 3.5 THEN 'good' WHEN mean >= 3 THEN 'fair' ELSE 'poor' END AS status, CASE WHEN late < early THEN 'declining' WHEN late > early THEN 'improving' ELSE 'stable' END AS trend,
 (SELECT event_type FROM k ORDER BY m, event_type LIMIT 1) AS improve, (SELECT event_type FROM k ORDER BY m DESC, event_type LIMIT 1) AS maintain, CASE WHEN mean < 3 THEN 'improve quality' WHEN mean < 4 THEN 'improve relevance' ELSE 'maintain' END AS advice FROM h""")
def satisfaction_advice(spark, d):
    """Ratings by value: how they stand, where they go, which kind is worst and which best, and what to do."""
    r = table(spark, d, "events").select(F.lit(0).alias("all"), "ts", "event_id", "event_type", (1 + F.least(F.lit(4), F.floor(F.col("value") / 4))).cast("double").alias("s"))
    halves = half_split(r, ["all"], ["ts", "event_id"], "s")
    kinds = r.groupBy("event_type").agg(F.avg("s").alias("m"))
    ends = kinds.agg(F.min(F.struct("m", "event_type"))["event_type"].alias("improve"), F.min(F.struct((-F.col("m")).alias("m"), "event_type"))["event_type"].alias("maintain"))
    told = r.agg(F.avg("s").alias("mean")).crossJoin(halves).crossJoin(ends)
    mean, early, late = F.col("mean"), F.col("first_half"), F.col("second_half")
    return told.select(
        F.round(mean, 6).alias("score"), F.when(mean >= 4, "excellent").when(mean >= 3.5, "good").when(mean >= 3, "fair").otherwise("poor").alias("status"), F.when(late < early, "declining").when(late > early, "improving").otherwise("stable").alias("trend"),
        "improve", "maintain", F.when(mean < 3, "improve quality").when(mean < 4, "improve relevance").otherwise("maintain").alias("advice"),
    )


@query("evt24_embedding_strategy", f"""
WITH RECURSIVE {_SESSIONS}, s AS (SELECT user_id, start, count(*) AS n, avg(value) / 20 AS score, (max(t) - start) / 1e6 / count(*) AS response FROM al GROUP BY 1, 2),
 u AS (SELECT user_id, sum(n * greatest(0, least(score, 1))) / sum(n) AS accuracy, sum(n * score) / sum(n) AS satisfaction, sum(n * response) / sum(n) AS response FROM s GROUP BY 1), p AS (SELECT *, greatest(0, 1 - response / 10) AS speed FROM u)
SELECT user_id, round(accuracy, 9) AS accuracy, round(satisfaction, 9) AS satisfaction, round(speed, 9) AS speed, CASE WHEN accuracy < 0.6 AND satisfaction < 0.6 THEN 'improved_accuracy_strategy' WHEN speed < 0.4 OR response > 8 THEN 'optimized_speed_strategy' WHEN (accuracy + speed + satisfaction) / 3 < 0.7 THEN 'balanced_strategy' ELSE 'incremental_improvement_strategy' END AS strategy FROM p""")
def embedding_strategy(spark, d):
    """By user: sessions' scores weighted by their events; memory and cost are below what would change the choice."""
    s = with_sessions(spark, d)
    each = s.groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("n"), (F.avg("value") / 20).alias("score"), ((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.col("start")) / 1e6 / F.count(F.lit(1))).alias("response"))
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    u = each.groupBy("user_id").agg(mean(F.greatest(F.lit(0.0), F.least(F.col("score"), F.lit(1.0)))).alias("accuracy"), mean(F.col("score")).alias("satisfaction"), mean(F.col("response")).alias("response"))
    p = u.withColumn("speed", F.greatest(F.lit(0.0), 1 - F.col("response") / 10))
    choice = F.when((F.col("accuracy") < 0.6) & (F.col("satisfaction") < 0.6), "improved_accuracy_strategy").when((F.col("speed") < 0.4) | (F.col("response") > 8), "optimized_speed_strategy").when((F.col("accuracy") + F.col("speed") + F.col("satisfaction")) / 3 < 0.7, "balanced_strategy").otherwise("incremental_improvement_strategy")
    return p.select("user_id", *[F.round(c, 9).alias(c) for c in ("accuracy", "satisfaction", "speed")], choice.alias("strategy"))


_EMBED = "list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(md5({0} || '_0'), i, 8) AS BIGINT) / 4294967295.0 * 2 - 1)"


@query("exp07_ranked_variants", f"""
WITH {_EXPANDED}, vv AS (SELECT conv_id, turn, q, unnest(s2[2:]) AS variant FROM x WHERE NOT short), cc AS (SELECT conv_id, turn, variant, round(list_cosine_similarity({_EMBED.format('q')}, {_EMBED.format('variant')}), 9) AS s FROM vv)
SELECT conv_id, turn, md5(variant) AS variant, round(s, 6) AS similarity FROM cc WHERE s > 0.2 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, variant) <= 2""")
def ranked_variants(spark, d):
    """Synonym variants by the likeness of their embedding to the query's; those over a threshold, the two best."""
    near = F.round(V.cosine(F.slice(V.hash_embedding(F.col("q"), F.lit(0), 4), 1, 4), F.slice(V.hash_embedding(F.col("variant"), F.lit(0), 4), 1, 4)), 9)
    v = asked(spark, d).filter(F.length(F.trim("q")) >= EX.SHORT).select("conv_id", "turn", "q", F.explode(F.slice(EX.synonyms(F.col("q")), 2, EX.MOST)).alias("variant")).withColumn("s", near).filter("s > 0.2")
    return R.first_of_each(v, ["conv_id", "turn"], [F.desc("s"), "variant"], 2).select("conv_id", "turn", F.md5("variant").alias("variant"), F.round("s", 6).alias("similarity"))


_PLAINED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("vec14_16_embedding_batches", "SELECT doc_id, " + ", ".join(f"round(CAST('0x' || substr(md5({_PLAINED} || '_0'), {8 * k + 1}, 8) AS BIGINT) / 4294967295.0 * 2 - 1, 9) AS x{k}" for k in range(4)) + " FROM documents")
def embedding_batches(spark, d):
    """Texts through an encoder that a task loads once, in batches of different texts."""
    e = V.embedded(table(spark, d, "documents"), "doc_id", "text", V.hash_embedder)
    return e.select("doc_id", *[F.round(F.get("embedding", F.lit(k)), 9).alias(f"x{k}") for k in range(4)])


_FIXED = " + ".join(f"CAST(contains(lower(text), {_Q(w)}) AS INT)" for w in X.TOXIC_FIXED)


@query("fun03_fixed_lexicon", f"WITH t AS (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' احمق و زشت' ELSE '' END AS text FROM conversations), n AS (SELECT conv_id, turn, {_FIXED} AS n FROM t) SELECT conv_id, turn, n, n > 0 AS toxic, round(least(n / 3, 1.0), 6) AS confidence FROM n")
def fixed_lexicon(spark, d):
    """Turns by the fixed words of two languages that they contain; every fourth one gets two more."""
    t = table(spark, d, "conversations").withColumn("text", F.concat("text", F.when(F.col("turn") % 4 == 0, " احمق و زشت").otherwise("")))
    n = X.held(F.col("text"), X.TOXIC_FIXED)
    return t.select("conv_id", "turn", n.alias("n"), (n > 0).alias("toxic"), F.round(F.least(n / 3, F.lit(1.0)), 6).alias("confidence"))


_ADVICE = "CASE pattern " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(_Q, v))}]" for k, v in RP.ADVICE.items()) + f" ELSE [{_Q(RP.OTHERWISE)}] END"


@query("evt10_recommendations", f"""
WITH RECURSIVE {_SESSIONS}, se AS (SELECT user_id, start, count(*) AS n, (max(t) - start) / 1e6 AS seconds FROM al GROUP BY 1, 2),
 tp AS (SELECT user_id, string_agg(event_type, ', ' ORDER BY n DESC, event_type) AS topics FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) <= 3) GROUP BY 1),
 p AS (SELECT user_id, avg(seconds) / 60 AS minutes, CASE WHEN avg(seconds) > 1800 AND sum(n)/count(*) > 10 THEN 'power_user' WHEN avg(seconds) > 600 AND sum(n)/count(*) > 5 THEN 'regular_user' WHEN sum(n)/count(*) > 2 THEN 'casual_user' ELSE 'light_user' END AS pattern FROM se GROUP BY 1)
SELECT user_id, pattern, array_to_string(list_concat({_ADVICE}, ['{RP.MORE_OF} ' || topics, CASE WHEN minutes > 30 THEN '{RP.IN_DEPTH}' ELSE '{RP.IN_BRIEF}' END]), '; ') AS advice FROM p JOIN tp USING (user_id)""")
def recommendations(spark, d):
    """Users by their pattern, with what is recommended to it, to their topics and to their sessions."""
    s = with_sessions(spark, d)
    each = s.groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("n"), ((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.col("start")) / 1e6).alias("seconds"))
    counted = s.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    topics = counted.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "event_type"))), lambda x: x["event_type"]).alias("topics"))
    p = each.groupBy("user_id").agg((F.avg("seconds") / 60).alias("minutes"), RP.usage_pattern(F.avg("seconds"), F.sum("n") / F.count(F.lit(1))).alias("pattern"))
    return p.join(topics, "user_id").select("user_id", "pattern", F.array_join(RP.advice(F.col("pattern"), F.col("topics"), F.col("minutes")), "; ").alias("advice"))
