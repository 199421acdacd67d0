"""Event, tenant and cache analytics, HTML and chunks over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import analytics as E
from skein.operators import chunkers as C
from skein.operators import neighbours as N
from skein.operators import scans as SC
from skein.operators import vectors as V
from skein.plans.registry import query, table
from skein.sources import html as H
from skein.streaming import cache as ST
from skein.streaming import events as SE

_SECONDS = 1_000_000


@query("evt01_sessions", """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
 f AS (SELECT user_id, i, t, t AS start FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - f.start > 3600000000 THEN e.t ELSE f.start END FROM f JOIN e ON e.user_id=f.user_id AND e.i=f.i+1)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) AS session, start, max(t) AS last, count(*) AS n FROM f GROUP BY user_id, start""")
def sessions(spark, d):
    return SC.sessions(table(spark, d, "events"), "user_id", "ts").select("user_id", "session", "start", "last", "n")


#: What ends the cache's entries: an hour, and the watermark that the stream ends with.
_ENTRIES = """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i FROM events),
 f AS (SELECT user_id, i, t, t AS made FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.t, CASE WHEN e.t - f.made > 3600000000 THEN e.t ELSE f.made END FROM f JOIN e ON e.user_id=f.user_id AND e.i=f.i+1),
 g AS (SELECT user_id, made, count(*) - 1 AS hits, lead(made) OVER (PARTITION BY user_id ORDER BY made) AS following FROM f GROUP BY user_id, made)
SELECT user_id, made, made + 3600000000 AS ended, hits FROM g WHERE following IS NOT NULL OR (made + 3600000000) // 1000 + 1 <= (SELECT max(t) // 1000 - 600000 FROM e)"""


@query("str11_expired_entries", _ENTRIES)
def expired_entries(spark, d):
    return ST.entries(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 3600)


@query("str11_stream_expired_entries", _ENTRIES)
def stream_expired_entries(spark, d):
    return SE.run_to_end(ST.expiring(SE.read(spark, d), "user_id", "ts", 3600), "entries", "append")


@query("evt02_11_profiles", """
SELECT user_id, count(*) AS events, count(*) FILTER (event_type='view') AS views, count(DISTINCT CAST(ts AS DATE)) AS days, round(avg(value) FILTER (value > 0),6) AS mean_value, epoch_us(max(ts)) AS last_active,
 CASE WHEN count(DISTINCT CAST(ts AS DATE))>20 AND count(*)>100 THEN 'power' WHEN count(DISTINCT CAST(ts AS DATE))>10 AND count(*)>50 THEN 'regular' WHEN count(DISTINCT CAST(ts AS DATE))>5 AND count(*)>20 THEN 'casual' WHEN count(DISTINCT CAST(ts AS DATE))>0 THEN 'new' ELSE 'inactive' END AS segment FROM events GROUP BY 1""")
def profiles(spark, d):
    t = table(spark, d, "events")
    days, n = F.countDistinct(F.to_date("ts")), F.count(F.lit(1))
    p = t.groupBy("user_id").agg(n.alias("events"), F.count(F.when(F.col("event_type") == "view", 1)).alias("views"), days.alias("days"), F.round(F.avg(F.when(F.col("value") > 0, F.col("value"))), 6).alias("mean_value"), F.max(E.micros(F.col("ts"))).alias("last_active"))
    return p.withColumn("segment", E.segment(F.col("days"), F.col("events")))


@query("evt05_weekly", "SELECT user_id, strftime(ts, '%Y') || '-' || lpad(CAST((dayofyear(ts) + 6 - (isodow(ts)-1))//7 AS VARCHAR), 2, '0') AS week, count(*) AS n FROM events GROUP BY 1, 2")
def weekly(spark, d):
    week = F.floor((F.dayofyear("ts") + 6 - F.weekday("ts")) / 7)
    return table(spark, d, "events").groupBy("user_id", F.concat(F.year("ts").cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("evt08_churn", """
WITH m AS (SELECT max(ts) t FROM events), u AS (SELECT user_id, datediff('day', CAST(max(ts) AS DATE), CAST((SELECT t FROM m) AS DATE)) idle, count(DISTINCT CAST(ts AS DATE)) s, least(1.0, avg(value)/100) q FROM events WHERE event_type='purchase' GROUP BY 1),
 c AS (SELECT *, CASE WHEN idle>30 THEN 3 WHEN idle>14 THEN 2 WHEN idle>7 THEN 1 ELSE 0 END + CASE WHEN s<3 THEN 2 WHEN s<10 THEN 1 ELSE 0 END + CASE WHEN q<0.3 THEN 2 WHEN q<0.6 THEN 1 ELSE 0 END score FROM u),
 p AS (SELECT *, CASE WHEN score>=6 THEN 0.9 WHEN score>=4 THEN 0.7 WHEN score>=3 THEN 0.5 WHEN score>=2 THEN 0.3 ELSE 0.1 END p FROM c)
SELECT user_id, score, CAST(p AS DOUBLE) AS probability, CASE WHEN p>0.7 THEN 'high' WHEN p>0.4 THEN 'medium' ELSE 'low' END AS status FROM p""")
def churn(spark, d):
    t = table(spark, d, "events")
    last = t.agg(F.max("ts").alias("t"))
    u = t.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("l"), F.countDistinct(F.to_date("ts")).alias("s"), F.least(F.lit(1.0), F.avg("value") / 100).alias("q")).join(F.broadcast(last))
    u = u.withColumn("score", E.churn_score(F.datediff(F.to_date("t"), F.to_date("l")), F.col("s"), F.col("q"))).withColumn("probability", E.churn_probability(F.col("score")))
    return u.select("user_id", "score", "probability", E.churn_status(F.col("probability")).alias("status"))


@query("evt12_hourly", "SELECT hour(ts) AS hour, isodow(ts)-1 AS weekday, count(*) AS n FROM events GROUP BY 1, 2")
def hourly(spark, d):
    return table(spark, d, "events").groupBy(F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


@query("evt13_daily", "WITH c AS (SELECT event_type, CAST(ts AS DATE) AS dd, count(*) AS n FROM events GROUP BY 1,2) SELECT event_type, round(avg(n),6) AS mean, round(var_pop(n),6) AS variance, round(1-var_pop(n)/avg(n),6) AS consistency FROM c GROUP BY 1")
def daily(spark, d):
    c = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("event_type").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.var_pop("n"), 6).alias("variance"), F.round(1 - F.var_pop("n") / F.avg("n"), 6).alias("consistency"))


@query("evt14_types", "SELECT event_type, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),4) AS share FROM events GROUP BY 1")
def types(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.select("event_type", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


@query("evt16_engagement", "WITH u AS (SELECT user_id, count(*) n, count(DISTINCT CAST(ts AS DATE)) dd FROM events GROUP BY 1) SELECT user_id, n AS activities, dd AS active_days, round(n/dd,6) AS per_day, CASE WHEN n/dd>10 THEN 'high' WHEN n/dd>=3 THEN 'medium' ELSE 'low' END AS level FROM u")
def engagement(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("activities"), F.countDistinct(F.to_date("ts")).alias("active_days"))
    per_day = F.col("activities") / F.col("active_days")
    return u.withColumns({"per_day": F.round(per_day, 6), "level": E.engagement(per_day)})


@query("evt17_trend", "WITH c AS (SELECT event_type, CAST(ts AS DATE) dd, count(*) n FROM events GROUP BY 1,2) SELECT event_type, round((max_by(n,dd)-min_by(n,dd))/count(*),6) AS trend FROM c GROUP BY 1")
def trend(spark, d):
    c = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("event_type").agg(F.round((F.max_by("n", "day") - F.min_by("n", "day")) / F.count(F.lit(1)), 6).alias("trend"))


@query("evt18_satisfaction", "WITH r AS (SELECT user_id, 1+least(4,floor(value/4)) s FROM events WHERE event_type='purchase') SELECT user_id, count(*) AS n, round(avg(s),6) AS mean, median(s) AS median, round(stddev_pop(s),6) AS std, count(*) FILTER (s>=4) AS satisfied, round(100.0*count(*) FILTER (s>=4)/count(*),4) AS share, CAST(array_to_string([count(*) FILTER (s=1), count(*) FILTER (s=2), count(*) FILTER (s=3), count(*) FILTER (s=4), count(*) FILTER (s=5)], ',') AS VARCHAR) AS histogram, CASE WHEN avg(s)>=4.5 THEN 'very high' WHEN avg(s)>=3.5 THEN 'high' WHEN avg(s)>=2.5 THEN 'medium' WHEN avg(s)>=1.5 THEN 'low' ELSE 'very low' END AS level FROM r GROUP BY 1")
def satisfaction(spark, d):
    """Ratings from 1 to 5 by the value of what was bought."""
    r = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", (1 + F.least(F.lit(4), F.floor(F.col("value") / 4))).alias("s"))
    good, n, mean = F.count(F.when(F.col("s") >= 4, 1)), F.count(F.lit(1)), F.avg("s")
    level = F.when(mean >= 4.5, "very high").when(mean >= 3.5, "high").when(mean >= 2.5, "medium").when(mean >= 1.5, "low").otherwise("very low")
    histogram = F.concat_ws(",", *[F.count(F.when(F.col("s") == k, 1)).cast("string") for k in range(1, 6)])
    return r.groupBy("user_id").agg(n.alias("n"), F.round(mean, 6).alias("mean"), F.median("s").alias("median"), F.round(F.stddev_pop("s"), 6).alias("std"), good.alias("satisfied"), F.round(100.0 * good / n, 4).alias("share"), histogram.alias("histogram"), level.alias("level"))


@query("evt20_query_clusters", "WITH k AS (SELECT conv_id, list_filter(string_split_regex(lower(text),'\\s+'), lambda w: length(w)>3 AND regexp_matches(w,'^[a-z]+$'))[1] k FROM conversations WHERE role='user') SELECT k AS keyword, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY 1 HAVING count(*)>1")
def clusters(spark, d):
    k = F.try_element_at(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: (F.length(w) > 3) & w.rlike("^[a-z]+$")), F.lit(1))
    return table(spark, d, "conversations").filter("role = 'user'").select(k.alias("keyword")).filter("keyword is not null").groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("evt26_anomalies", """
WITH s AS (SELECT event_type k, avg(value) m, coalesce(stddev_samp(value),0) sd FROM events GROUP BY 1), a AS (SELECT event_id, CASE WHEN sd>0 AND abs(value-m)>3*sd THEN 'critical' WHEN sd>0 AND abs(value-m)>2*sd THEN 'high' WHEN value<0 THEN 'high' WHEN value>1000 THEN 'medium' END sev FROM events JOIN s ON k=event_type)
SELECT event_id, sev AS severity FROM a WHERE sev IS NOT NULL""")
def anomalies(spark, d):
    t = table(spark, d, "events")
    s = t.groupBy("event_type").agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"))
    return t.join(s, "event_type").select("event_id", E.anomaly(F.col("value"), F.col("m"), F.col("sd")).alias("severity")).filter("severity is not null")


@query("evt28_load_pattern", "WITH h AS (SELECT hour(ts) h, avg(value) m, var_samp(value) v FROM events GROUP BY 1) SELECT h AS hour, round(m,6) AS mean, round(v,6) AS variance, row_number() OVER (ORDER BY m DESC, h) <= 3 AS peak FROM h")
def load(spark, d):
    h = table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    return h.select("hour", F.round("m", 6).alias("mean"), F.round("v", 6).alias("variance"), (F.row_number().over(Window.partitionBy().orderBy(F.desc("m"), "hour")) <= 3).alias("peak"))


@query("evt30_capacity", "SELECT l_suppkey AS s_suppkey, round(u,6) AS used, CAST(CASE WHEN u>=90 THEN 0 ELSE least(ceil(ln(90/u)/ln(1+0.3/30)),365) END AS BIGINT) AS days FROM (SELECT l_suppkey, greatest(1.0, 100.0*count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01')/count(*)) u FROM lineitem GROUP BY 1)")
def capacity(spark, d):
    """What share of a supplier's lines had shipped by a day, as capacity in use."""
    used = F.greatest(F.lit(1.0), 100.0 * F.count(F.when(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"), 1)) / F.count(F.lit(1)))
    u = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(used.alias("u"))
    return u.select("s_suppkey", F.round("u", 6).alias("used"), E.capacity_days(F.col("u"), 0.3).cast("long").alias("days"))


_TENANT = "SELECT n_nationkey tenant, count(*) q, sum(o_totalprice) rev, CASE n_regionkey WHEN 0 THEN 'free' WHEN 1 THEN 'basic' WHEN 2 THEN 'premium' ELSE 'enterprise' END tier FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1, n_regionkey"


@query("evt32_33_tenant_usage", f"WITH t AS ({_TENANT}), l AS (SELECT * FROM (VALUES ('free',100,0.0),('basic',1000,10.0),('premium',10000,50.0),('enterprise',100000,200.0)) v(tier,lim,base)) SELECT tenant, tier, q AS queries, round(least(100.0,100.0*q/lim),4) AS used, round(base+0.001*q+0.01*q,6) AS cost FROM t JOIN l USING (tier)")
def tenants(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    tier = F.when(F.col("n_regionkey") == 0, "free").when(F.col("n_regionkey") == 1, "basic").when(F.col("n_regionkey") == 2, "premium").otherwise("enterprise")
    by_customer = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("q"))
    t = by_customer.join(c, "c_custkey").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("tenant"), tier.alias("tier")).agg(F.sum("q").alias("queries"))
    limits = spark.createDataFrame([("free", 100, 0.0), ("basic", 1000, 10.0), ("premium", 10000, 50.0), ("enterprise", 100000, 200.0)], "tier string, lim long, base double")
    return t.join(F.broadcast(limits), "tier").select("tenant", "tier", "queries", F.round(F.least(F.lit(100.0), 100.0 * F.col("queries") / F.col("lim")), 4).alias("used"), E.usage_cost(F.col("queries"), F.lit(0.0), F.col("queries"), F.col("base"), 6).alias("cost"))


@query("evt36_quota", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def quota(spark, d):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) <= 2).alias("allowed"))


@query("evt43_45_status", "WITH h AS (SELECT hour(ts) h, avg(value) v, avg(CAST(event_type='error' AS INT)) e FROM events GROUP BY 1), s AS (SELECT h, greatest(0,100-CASE WHEN v>90 THEN 30 WHEN v>80 THEN 15 ELSE 0 END-CASE WHEN v*5>95 THEN 30 WHEN v*5>85 THEN 15 ELSE 0 END-CASE WHEN e>0.1 THEN 30 WHEN e>0.05 THEN 15 ELSE 0 END) s FROM h) SELECT h AS hour, s AS score, CASE WHEN s>=90 THEN 'excellent' WHEN s>=70 THEN 'good' WHEN s>=50 THEN 'fair' WHEN s>=30 THEN 'poor' ELSE 'critical' END AS band FROM s")
def status(spark, d):
    h = table(spark, d, "events").groupBy(F.hour("ts").alias("hour")).agg(F.avg("value").alias("v"), F.avg((F.col("event_type") == "error").cast("int")).alias("e"))
    s = h.select("hour", E.health(F.col("v"), F.col("v") * 5, F.col("e")).alias("score"))
    return s.withColumn("band", E.health_band(F.col("score")))


_LIMITED = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 f AS (SELECT event_id, user_id, i, true AS allowed, [t] AS log FROM e WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, len(log) < 3, CASE WHEN len(log) < 3 THEN list_append(log, t) ELSE log END
  FROM (SELECT e.event_id, e.user_id, e.i, e.t, list_filter(f.log, lambda x: x > e.t - 86400000000) AS log FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) g)
SELECT event_id, user_id, allowed FROM f"""


@query("str01_rate_limit", _LIMITED)
def rate_limit(spark, d):
    return SC.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 86_400)


@query("str04_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def windows(spark, d):
    t = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return t.select(F.col("w.start").alias("start"), "event_type", "n", "users")


#: Bounds of the value's buckets; values over the last lie in the open one.
BOUNDS = [1.0, 2.0, 5.0, 10.0, 20.0, 30.0]


@query("str05_histogram_quantiles", f"""
WITH w AS (SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS start, event_type, value FROM events WHERE value IS NOT NULL),
 b AS (SELECT start, event_type, ub, i, count(*) FILTER (value <= ub) AS upto, count(*) AS total FROM w, (SELECT unnest({BOUNDS + [1e300]}) AS ub, unnest(range({len(BOUNDS) + 1})) AS i) GROUP BY 1, 2, 3, 4),
 p AS (SELECT *, lag(ub, 1, 0) OVER k AS low, lag(upto, 1, 0) OVER k AS before FROM b WINDOW k AS (PARTITION BY start, event_type ORDER BY i)),
 q AS (SELECT p.*, share FROM p, (SELECT unnest([0.5, 0.95]) AS share)),
 f AS (SELECT start, event_type, share, arg_min(CASE WHEN i = {len(BOUNDS)} THEN {BOUNDS[-1]} ELSE low + (ub - low) * (share * total - before) / (upto - before) END, i) AS v FROM q WHERE upto >= share * total GROUP BY 1, 2, 3)
SELECT start, event_type, round(max(v) FILTER (share = 0.5), 6) AS p50, round(max(v) FILTER (share = 0.95), 6) AS p95 FROM f GROUP BY 1, 2""")
def histogram_quantiles(spark, d):
    t = table(spark, d, "events").withColumn("start", F.unix_micros(F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"]))
    h = E.histogram(t, [F.col("start"), F.col("event_type")], "value", BOUNDS)
    return h.select("start", "event_type", F.round(E.histogram_quantile(0.5, F.col("buckets"), BOUNDS), 6).alias("p50"), F.round(E.histogram_quantile(0.95, F.col("buckets"), BOUNDS), 6).alias("p95"))


@query("str05_latency_alert", f"""
WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, value FROM events), c AS (SELECT epoch_us(day) AS start, event_type, count(*) AS n, count(*) FILTER (value <= 20) AS a, count(*) FILTER (value <= 30) AS b, count(*) FILTER (value <= 10) AS z FROM w GROUP BY 1, 2)
SELECT start, event_type FROM c WHERE NOT (a >= 0.95 * n) AND (CASE WHEN b >= 0.95 * n THEN 20 + 10 * (0.95 * n - a) / (b - a) ELSE 30 END) > 25""")
def latency_alert(spark, d):
    """Days on which the 95th hundredth of a kind of event was over 25."""
    t = table(spark, d, "events").withColumn("start", F.unix_micros(F.window(F.col("ts").cast("timestamp"), "1 day")["start"]))
    h = E.histogram(t, [F.col("start"), F.col("event_type")], "value", BOUNDS)
    return h.filter(E.histogram_quantile(0.95, F.col("buckets"), BOUNDS) > 25).select("start", "event_type")


@query("str05_error_rate", "SELECT event_id, round(avg(CAST(event_type='error' AS INT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW),6) AS rate FROM events")
def error_rate(spark, d):
    t = table(spark, d, "events").withColumn("t", E.micros(F.col("ts")))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-300 * _SECONDS, 0)
    return t.select("event_id", F.round(F.avg((F.col("event_type") == "error").cast("int")).over(w), 6).alias("rate"))


@query("str07_alert_dedup", "WITH g AS (SELECT event_id, user_id, epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM events WHERE event_type='error') SELECT event_id, user_id FROM g WHERE g IS NULL OR g > 300000000")
def dedup(spark, d):
    return E.alerts(table(spark, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query("str09_bounded_history", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 20")
def history(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).filter("r <= 20").select("event_id")


@query("cac01_semantic_lookup", """
WITH p AS (SELECT q.vec_id qid, r.vec_id id, round(list_inner_product(q.embedding::DOUBLE[],r.embedding::DOUBLE[])/(sqrt(list_inner_product(q.embedding::DOUBLE[],q.embedding::DOUBLE[]))*sqrt(list_inner_product(r.embedding::DOUBLE[],r.embedding::DOUBLE[]))),9) s FROM embeddings q JOIN embeddings r ON q.label=r.label AND q.vec_id<>r.vec_id WHERE q.vec_id % 50 = 0),
 b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) k FROM p WHERE s >= 0.2) SELECT qid AS query_id, id, round(s,6) AS score FROM b WHERE k = 1""")
def lookup(spark, d):
    e = table(spark, d, "embeddings")
    # Two, as a query's own entry is one of them.
    best = N.within(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "label", 2).filter("id <> query_id AND score >= 0.2")
    first = best.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return first.select("query_id", "b.id", F.round(-F.col("b.s"), 6).alias("score"))


#: A cache's entries: a user's kinds of events; hits are all but the first, times are told from the last event of all.
_CACHE = "SELECT user_id, event_type, count(*) access_, (max(max(epoch_us(ts))) OVER () - min(epoch_us(ts)))/1e6 age, (max(max(epoch_us(ts))) OVER () - max(epoch_us(ts)))/1e6 idle, least(1.0, avg(value)/20) qual FROM events GROUP BY 1, 2"


def _entries(spark, d):
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    last = e.agg(F.max(at).alias("last"))
    held = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("a"), F.min(at).alias("made"), F.max(at).alias("seen"), F.least(F.lit(1.0), F.avg("value") / 20).alias("q"))
    return held.crossJoin(last).withColumns({"age": (F.col("last") - F.col("made")) / 1e6, "idle": (F.col("last") - F.col("seen")) / 1e6})


@query("cac03_05_eviction", f"WITH c AS ({_CACHE}), s AS (SELECT *, round(access_/(age+1),12) u, round(0.4*least(access_/100,1.0)+0.3/(1+idle)+0.2*qual+0.1*least(access_/(age+1),1.0),9) a FROM c) SELECT user_id, min_by(event_type, (u, event_type)) AS usage, min_by(event_type, (-idle, event_type)) AS lru, min_by(event_type, (access_, event_type)) AS lfu, min_by(event_type, (a, event_type)) AS adaptive FROM s GROUP BY 1")
def eviction(spark, d):
    """The entry of each user that goes first, by each way."""
    t = _entries(spark, d)
    digits = {"usage": 12}
    first = lambda how: F.min_by("event_type", F.struct(F.round(E.eviction_order(how, F.col("a"), F.col("age"), F.col("idle"), F.col("q")).cast("double"), digits.get(how, 9)), "event_type")).alias(how)
    return t.groupBy("user_id").agg(*map(first, ("usage", "lru", "lfu", "adaptive")))


@query("cac06_09_rates", f"WITH c AS ({_CACHE}), r AS (SELECT user_id, count(*) FILTER (idle<=604800) live, count(*) n, sum(access_-1)/sum(access_) hit, count(*) FILTER (idle>604800)/count(*) evicted, sum(access_-1)/sum(access_)*count(*) FILTER (idle<=604800)/count(*) efficiency FROM c GROUP BY 1) SELECT user_id, live, n, round(hit,6) AS hit_rate, round(1-hit,6) AS miss_rate, round(evicted,6) AS eviction_rate, round(efficiency,6) AS efficiency, CASE WHEN hit<0.5 THEN least(CAST(floor(1000*1.2) AS INT),2000) WHEN hit>0.9 THEN greatest(CAST(floor(1000*0.8) AS INT),500) ELSE 1000 END AS size FROM r")
def rates(spark, d):
    """Hits, misses and what has gone after a week without access, by user; and the size that follows."""
    live, n = F.count(F.when(F.col("idle") <= 604_800, 1)), F.count(F.lit(1))
    hit = F.sum(F.col("a") - 1) / F.sum("a")
    r = _entries(spark, d).groupBy("user_id").agg(live.alias("live"), n.alias("n"), hit.alias("hit"), ((n - live) / n).alias("evicted"), (hit * live / n).alias("efficiency"))
    return r.select("user_id", "live", "n", F.round("hit", 6).alias("hit_rate"), F.round(1 - F.col("hit"), 6).alias("miss_rate"), F.round("evicted", 6).alias("eviction_rate"), F.round("efficiency", 6).alias("efficiency"), E.resized(F.lit(1000), F.col("hit")).alias("size"))


@query("src05_13_html_content")
def content(spark, d):
    return table(spark, d, "pages").select("page_id", H.content(F.col("html")).alias("text"))


@query("src07_html_metadata", """SELECT page_id, regexp_extract(html, '<html[^>]*\\blang="([^"]*)"', 1) AS lang, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),'&lt;','<'),'&gt;','>'),'&quot;','"'),'&#39;',''''),'&nbsp;',' '),'&amp;','&')) AS title FROM pages""")
def metadata(spark, d):
    return table(spark, d, "pages").select("page_id", H.language(F.col("html")).alias("lang"), H.title(F.col("html")).alias("title"))


@query("src08_html_headings", "WITH h AS (SELECT page_id, len(regexp_extract_all(html,'(?is)<h1[^>]*>(.*?)</h1>',1)) h1, len(regexp_extract_all(html,'(?is)<h2[^>]*>(.*?)</h2>',1)) h2 FROM pages) SELECT page_id, h1, h2 FROM h")
def headings(spark, d):
    h = H.headings(F.col("html"))
    level = lambda n: F.size(F.filter("h", lambda x: x["level"] == n)).alias(f"h{n}")
    return table(spark, d, "pages").select("page_id", h.alias("h")).select("page_id", level(1), level(2))


@query("src09_html_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html,'(?i)<a\\s[^>]*href="([^"]+)"',1)) link FROM pages) SELECT DISTINCT page_id, link FROM l""")
def links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("link"))


@query("src11_absolute_links", """WITH l AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html,'(?i)<a\\s[^>]*href="([^"]+)"',1)) link FROM pages) SELECT page_id, CASE WHEN regexp_matches(link,'^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN link WHEN starts_with(link,'/') THEN regexp_extract(url,'^(https?://[^/?#]+)',1)||link ELSE regexp_replace(regexp_replace(url,'[?#].*$',''),'/[^/]*$','/')||link END AS target FROM l""")
def absolute(spark, d):
    t = table(spark, d, "pages").select("page_id", "url", F.explode(H.links(F.col("html"))).alias("link"))
    return t.select("page_id", H.absolute(F.col("url"), F.col("link")).alias("target"))


@query("src15_markdown_metadata", "SELECT doc_id, len(regexp_extract_all(text,'(?m)^#{1,6}\\s+\\S')) AS headings, len(regexp_extract_all(text,'(?m)^\\s*[-*+]\\s+')) AS bullets, len(regexp_extract_all(text,'(?m)^>\\s?')) AS quotes FROM documents")
def markdown(spark, d):
    m = H.markdown_metadata(F.col("text"))
    return table(spark, d, "documents").select("doc_id", m["headings"].alias("headings"), m["bullets"].alias("bullets"), m["quotes"].alias("quotes"))


@query("src19_row_text", "SELECT c_custkey, 'row ' || CAST(c_custkey AS VARCHAR) || ': c_name=' || c_name || ', c_mktsegment=' || c_mktsegment AS text FROM customer")
def row_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", H.row_text(["c_name", "c_mktsegment"], F.col("c_custkey")).alias("text"))


@query("src24_25_dispatch", "SELECT page_id, CASE WHEN regexp_matches(url,'^https?://') THEN 'url' ELSE 'text' END AS loader FROM pages")
def dispatch(spark, d):
    return table(spark, d, "pages").select("page_id", H.loader_of(F.col("url")).alias("loader"))


@query("chk01_05_token_chunks", """
WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text,'\\s+'), lambda x: x<>'') w FROM documents), g AS (SELECT doc_id, text, w, unnest(generate_series(0, CASE WHEN len(w)<=358 THEN 0 ELSE CAST(ceil((len(w)-358)/308.0) AS BIGINT) END)) i FROM t)
SELECT doc_id, CAST(i AS INT) AS chunk, md5(CASE WHEN len(w)<=358 THEN text ELSE array_to_string(w[i*308+1:i*308+358],' ') END) AS content, substr(md5(doc_id||'_'||i||'_358_50'),1,12) AS chunk_id FROM g""")
def token_chunks(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.posexplode(C.token_chunks(F.col("text"))).alias("chunk", "content"))
    return t.select("doc_id", "chunk", F.md5("content").alias("content"), C.chunk_id(F.col("doc_id"), F.col("chunk"), C.SIZE, C.OVERLAP).alias("chunk_id"))


@query("chk06_estimate", "SELECT doc_id, greatest(1,(n_chars-50)//(358-50)) AS estimate FROM documents")
def estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", C.chunk_estimate(F.col("n_chars"), 358, 50).alias("estimate"))


@query("chk10_sentences", """WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？؟])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) >= 8) AS v FROM documents) SELECT doc_id, unnest(range(len(v))) AS position, unnest(v) AS sentence FROM s""")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("position", "sentence"))


_PROSE = " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in C.PROSE)


@query("chk17_21_22_analysis", f"""
WITH a AS (SELECT doc_id, length(text) AS length, len(list_filter(string_split_regex(text,'\\s+'), lambda x: x<>'')) AS n_words, len(regexp_extract_all(text,'[.!?]+')) AS n_sentences, len(list_filter(string_split_regex(text,'\\n\\s*\\n'), lambda p: trim(p)<>'')) AS n_paragraphs,
 least(1.0, (len(regexp_extract_all(text,'(?m)^#+\\s+')) + len(regexp_extract_all(text,'(?m)^\\s*[-*+]\\s+')) + length(text) - length(replace(text,'|','')))/greatest(length(text)/1000.0,1.0)) AS st, {_PROSE} AS pr FROM documents),
 b AS (SELECT *, least(1.0, pr/(greatest(n_words,1)/10.0)) AS se FROM a)
SELECT doc_id, length, n_words, n_sentences, n_paragraphs, round(st,6) AS structure, round(se,6) AS semantic, CASE WHEN st>0.3 THEN 'hierarchical' WHEN se>0.7 THEN 'semantic' WHEN length>5000 THEN 'hybrid' ELSE 'token' END AS strategy FROM b""")
def analysis(spark, d):
    a = C.analysis(F.col("text"))
    t = table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in a.items()])
    return t.withColumn("strategy", C.strategy(F.col("length"), F.col("structure"), F.col("semantic"))).withColumns({n: F.round(n, 6) for n in ("structure", "semantic")})


@query("chk19_20_optimised")
def optimised(spark, d):
    return C.quality(C.optimised(table(spark, d, "documents"), "doc_id", "text"), "content", ["doc_id"])


@query("snk01_05_upsert", """
SELECT 'added' AS what, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'updated', count(*) FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING' UNION ALL SELECT 'deleted', count(*) FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 9000""")
def upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    store, batch_ = c.filter("c_mktsegment <> 'BUILDING'"), c.filter("c_mktsegment = 'BUILDING' or c_acctbal < 0")
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    added, updated = batch_.join(store, "c_custkey", "left_anti"), batch_.join(store, "c_custkey", "left_semi")
    deleted = store.join(store.filter("c_acctbal > 9000").select("c_custkey"), "c_custkey", "left_semi")
    return n(added, "added").union(n(updated, "updated")).union(n(deleted, "deleted"))


@query("snk09_10_copy_check", "SELECT count(*) AS rows_, 0 AS differing FROM orders")
def copy_check(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.xxhash64("o_custkey", "o_totalprice", "o_orderstatus").alias("h"))
    b = a.select("o_orderkey", F.col("h").alias("g"))
    return a.join(b, "o_orderkey", "full").agg(F.count(F.lit(1)).alias("rows_"), F.sum((~F.col("h").eqNullSafe(F.col("g"))).cast("int")).alias("differing"))


@query("snk11_12_usage", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2")
def usage(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("str12_stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    from skein.streaming import events as S

    t = S.run_to_end(S.windowed_counts(S.read(spark, d)), "stream_windows", "complete")
    return t.select(F.unix_micros("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str01_stream_rate_limit", _LIMITED)
def stream_rate_limit(spark, d):
    from skein.streaming import events as S

    return S.run_to_end(S.rate_limited(S.read(spark, d), "user_id", 3, 86_400), "stream_rate_limit", "append")
