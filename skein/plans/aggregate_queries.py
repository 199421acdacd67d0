"""Aggregates, windows, sorts, joins and set operations over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import aggregation as A
from skein.plans.registry import query, table

_SUMMARY = "count(*) AS count, round(sum(coalesce(v,0)),4) AS sum, round(avg(coalesce(v,0)),4) AS avg, round(min(coalesce(v,0)),4) AS min, round(max(coalesce(v,0)),4) AS max, round(median(coalesce(v,0)),4) AS median, round(coalesce(stddev_samp(coalesce(v,0)),0),4) AS std, round(coalesce(var_samp(coalesce(v,0)),0),4) AS var"


@query("agg01_group", f"SELECT l_returnflag, {_SUMMARY} FROM (SELECT l_returnflag, l_quantity AS v FROM lineitem) GROUP BY l_returnflag")
def group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(*A.rounded(A.summary(F.col("l_quantity"))))


@query("agg02_multi", f"SELECT l_returnflag || '|' || coalesce(l_linestatus,'null') AS grp, {_SUMMARY} FROM (SELECT *, l_discount AS v FROM lineitem) GROUP BY 1")
def multi(spark, d):
    return table(spark, d, "lineitem").groupBy(A.group_key("l_returnflag", "l_linestatus").alias("grp")).agg(*A.rounded(A.summary(F.col("l_discount"))))


@query("agg03_07_global", f"SELECT {_SUMMARY}, round(max(v)-min(v),4) AS range FROM (SELECT o_totalprice AS v FROM orders)")
def whole(spark, d):
    return table(spark, d, "orders").agg(*A.rounded(A.summary(F.col("o_totalprice")) | {"range": F.max("o_totalprice") - F.min("o_totalprice")}))


@query("agg04_percentile_exclusive", """
WITH r AS (SELECT l_returnflag k, l_extendedprice v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) i, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem),
 j AS (SELECT *, greatest(1, least((25*(n+1))//100, n-1)) j25, greatest(1, least((95*(n+1))//100, n-1)) j95 FROM r)
SELECT k AS l_returnflag, round((max(CASE WHEN i=j25 THEN v END)*(100-max(25*(n+1)-j25*100))+max(CASE WHEN i=j25+1 THEN v END)*max(25*(n+1)-j25*100))/100,4) AS p25,
 round((max(CASE WHEN i=j95 THEN v END)*(100-max(95*(n+1)-j95*100))+max(CASE WHEN i=j95+1 THEN v END)*max(95*(n+1)-j95*100))/100,4) AS p95 FROM j GROUP BY k""")
def exclusive(spark, d):
    p = A.percentile_exclusive(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"], [25, 95])
    return p.select("l_returnflag", F.round("p25", 4).alias("p25"), F.round("p95", 4).alias("p95"))


@query("agg05_percentile_index", "WITH r AS (SELECT l_linestatus k, l_extendedprice v, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice)-1 i, count(*) OVER (PARTITION BY l_linestatus) n FROM lineitem) SELECT k AS l_linestatus, " + ", ".join(f"max(CASE WHEN i = ({p}*(n-1))//100 THEN v END) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM r GROUP BY k")
def index(spark, d):
    return A.percentile_index(table(spark, d, "lineitem"), "l_extendedprice", ["l_linestatus"], [25, 50, 75, 90, 95, 99])


@query("agg06_percentile_length", "WITH r AS (SELECT event_type k, value v, row_number() OVER (PARTITION BY event_type ORDER BY value)-1 i, count(*) OVER (PARTITION BY event_type) n FROM events WHERE value IS NOT NULL) SELECT k AS event_type, " + ", ".join(f"max(CASE WHEN i = ({p}*n)//100 THEN v END) AS p{p}" for p in (50, 95, 99)) + " FROM r GROUP BY k")
def length(spark, d):
    return A.percentile_length(table(spark, d, "events"), "value", ["event_type"])


@query("agg08_mode", "WITH c AS (SELECT o_orderpriority m, count(*) f FROM orders GROUP BY 1) SELECT m AS mode, f AS frequency, (SELECT count(*) FROM c) AS distinct_values FROM c ORDER BY f DESC, m LIMIT 1")
def mode(spark, d):
    return A.mode(table(spark, d, "orders"), "o_orderpriority")


@query("agg09_count_dates", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate <= TIMESTAMP '1995-01-01'")
def count_dates(spark, d):
    return table(spark, d, "orders").filter("o_orderdate >= timestamp'1994-01-01' and o_orderdate <= timestamp'1995-01-01'").agg(F.count(F.lit(1)).alias("n"))


@query("agg10_query_object", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice),2) AS avg FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 10 ORDER BY 1 LIMIT 5")
def query_object(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 1000").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg")).filter("n > 10").orderBy("o_orderstatus").limit(5)


@query("agg11_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@query("agg12_13_population", "SELECT event_type, round(var_pop(value),4) AS var, round(stddev_pop(value),4) AS std, round(avg(value),4) AS mean, round(median(value),4) AS median FROM events GROUP BY 1")
def population(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.var_pop("value"), 4).alias("var"), F.round(F.stddev_pop("value"), 4).alias("std"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"))


@query("agg14_shares", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 2000) AS long_texts, round(100.0*count(*) FILTER (n_chars > 2000)/count(*),2) AS share FROM documents GROUP BY 1")
def shares(spark, d):
    long_ = F.count(F.when(F.col("n_chars") > 2000, 1))
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), long_.alias("long_texts"), F.round(100.0 * long_ / F.count(F.lit(1)), 2).alias("share"))


@query("agg15_window", "WITH m AS (SELECT max(ts) t FROM events) SELECT event_type, round(avg(value),4) AS avg, round(sum(value),4) AS sum, min(value) AS min, max(value) AS max, count(*) AS count FROM events, m WHERE ts > t - INTERVAL 1440 MINUTE AND ts <= t GROUP BY 1")
def window(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("as_of"))
    w = A.windowed(e.join(F.broadcast(last)), "ts", "value", ["event_type"], F.col("as_of"), 1440)
    return w.select("event_type", F.round("avg", 4).alias("avg"), F.round("sum", 4).alias("sum"), "min", "max", "count")


@query("agg17_cube", "SELECT coalesce(l_returnflag,'*') AS flag, coalesce(l_linestatus,'*') AS status, count(*) AS n, round(sum(l_quantity),2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    c = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query("jon01_inner_top", "SELECT n_name, round(sum(l_extendedprice*(1-l_discount)),2) AS revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1")
def inner(spark, d):
    line, orders, customers, nations = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == customers.c_custkey).join(F.broadcast(nations), F.col("c_nationkey") == nations.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("jon02_full_outer", "SELECT coalesce(a.k,b.k) AS k, coalesce(a.n,0) AS sup, coalesce(b.n,0) AS cust FROM (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey k, count(*) n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) b ON a.k=b.k")
def full(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("sup"))
    b = table(spark, d, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("cust"))
    return a.join(b, "k", "full").select("k", F.coalesce("sup", F.lit(0)).alias("sup"), F.coalesce("cust", F.lit(0)).alias("cust"))


@query("jon03_04_left", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice),0),2) AS total FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def left(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("jon05_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 300000)")
def semi(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000")
    c = table(spark, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("jon06_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)")
def anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("jon08_interval_overlap", """
WITH c AS (SELECT doc_id, g AS chunk, g*500 AS s, least((g+1)*500, n_chars) AS e FROM documents, LATERAL (SELECT unnest(generate_series(0, CAST(greatest(0,(n_chars-1)//500) AS BIGINT))) AS g)),
 p AS (SELECT doc_id, g AS page, g*700 AS rs, (g+1)*700 AS re FROM documents, LATERAL (SELECT unnest(generate_series(0, CAST(n_chars//700 AS BIGINT))) AS g))
SELECT c.doc_id, chunk, min(page) AS page FROM c JOIN p ON c.doc_id=p.doc_id AND s < re AND e > rs GROUP BY 1,2""")
def overlap(spark, d):
    docs = table(spark, d, "documents")
    c = docs.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("n_chars") - 1) / 500)))).alias("chunk")).select("doc_id", "chunk", (F.col("chunk") * 500).alias("s"), F.least((F.col("chunk") + 1) * 500, "n_chars").alias("e"))
    p = docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 700))).alias("page")).select("doc_id", "page", (F.col("page") * 700).alias("rs"), ((F.col("page") + 1) * 700).alias("re"))
    return c.join(p, "doc_id").filter("s < re and e > rs").groupBy("doc_id", "chunk").agg(F.min("page").alias("page"))


@query("jon09_as_of", "SELECT event_id, user_id, max(CASE WHEN event_type='signup' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_signup FROM events")
def as_of(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w).alias("last_signup"))


@query("jon11_calendar", """
WITH b AS (SELECT min(CAST(ts AS DATE)) lo, max(CAST(ts AS DATE)) hi FROM events), c AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT day, count(event_id) AS n FROM c LEFT JOIN events ON CAST(ts AS DATE)=day AND event_type='error' GROUP BY 1""")
def calendar(spark, d):
    e = table(spark, d, "events")
    days = e.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    n = e.filter("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("set01_02", """
SELECT 'intersect' AS op, k FROM (SELECT s_nationkey k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)
UNION ALL SELECT 'union', k FROM (SELECT s_nationkey k FROM supplier WHERE s_acctbal > 8000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)
UNION ALL SELECT 'except', k FROM (SELECT n_nationkey k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def sets(spark, d):
    s, c, n = (table(spark, d, t) for t in ("supplier", "customer", "nation"))
    key = lambda df, k, where="true": df.filter(where).select(F.col(k).alias("k"))
    both = key(s, "s_nationkey").intersect(key(c, "c_nationkey", "c_acctbal > 9000"))
    either = key(s, "s_nationkey", "s_acctbal > 8000").union(key(c, "c_nationkey", "c_acctbal > 9900")).distinct()
    rest = key(n, "n_nationkey").subtract(key(s, "s_nationkey", "s_acctbal > 5000"))
    named = lambda df, op: df.select(F.lit(op).alias("op"), "k")
    return named(both, "intersect").union(named(either, "union")).union(named(rest, "except"))


@query("win01_02_rank_running", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING),2) AS running FROM orders")
def running(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rank"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("win03_half_split", """
WITH r AS (SELECT user_id, value v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 i, count(*) OVER (PARTITION BY user_id) n FROM events),
 g AS (SELECT user_id, count(*) n, avg(v) FILTER (i < n//2) a, avg(v) FILTER (i >= n//2) b FROM r GROUP BY 1)
SELECT user_id, n, round(a,7) AS first_half, round(b,7) AS second_half, CASE WHEN b > a + 0.5 THEN 'improving' WHEN b < a - 0.5 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def half(spark, d):
    h = A.half_split(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    trend = F.when(F.col("second_half") > F.col("first_half") + 0.5, "improving").when(F.col("second_half") < F.col("first_half") - 0.5, "declining").otherwise("stable")
    return h.select("user_id", "n", F.round("first_half", 7).alias("first_half"), F.round("second_half", 7).alias("second_half"), trend.alias("trend"))


@query("win04_ends", """
WITH r AS (SELECT event_type k, value v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) i, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) b FROM events),
 g AS (SELECT k, count(*) n, avg(v) FILTER (i <= 10) f, avg(v) FILTER (b <= 10) l FROM r GROUP BY 1)
SELECT k AS event_type, round(f,4) AS first, round(l,4) AS last, CASE WHEN n < 20 THEN 'insufficient' WHEN l > f*1.2 THEN 'degrading' WHEN l < f*0.8 THEN 'improving' ELSE 'stable' END AS trend FROM g""")
def ends(spark, d):
    e = A.ends(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", 10)
    trend = F.when(F.col("n") < 20, "insufficient").when(F.col("last") > F.col("first") * 1.2, "degrading").when(F.col("last") < F.col("first") * 0.8, "improving").otherwise("stable")
    return e.select("event_type", F.round("first", 4).alias("first"), F.round("last", 4).alias("last"), trend.alias("trend"))


@query("win05_week_over_week", """
WITH c AS (SELECT event_type k, CAST(ts AS DATE) dd, count(*) n FROM events GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY dd DESC) b FROM c),
 g AS (SELECT k, avg(n) FILTER (b <= 7) a, avg(n) FILTER (b > 7 AND b <= 14) p FROM r GROUP BY 1)
SELECT k AS event_type, round(a,4) AS recent, round(p,4) AS previous, CASE WHEN p IS NULL THEN 'stable' WHEN a > p*1.1 THEN 'increasing' WHEN a < p*0.9 THEN 'decreasing' ELSE 'stable' END AS trend FROM g""")
def weeks(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    r = daily.withColumn("b", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day"))))
    g = r.groupBy("event_type").agg(F.avg(F.when(F.col("b") <= 7, F.col("n"))).alias("a"), F.avg(F.when(F.col("b").between(8, 14), F.col("n"))).alias("p"))
    trend = F.when(F.col("p").isNull(), "stable").when(F.col("a") > F.col("p") * 1.1, "increasing").when(F.col("a") < F.col("p") * 0.9, "decreasing").otherwise("stable")
    return g.select("event_type", F.round("a", 4).alias("recent"), F.round("p", 4).alias("previous"), trend.alias("trend"))


@query("win07_slope", "WITH r AS (SELECT event_type k, value v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) i FROM events) SELECT k AS event_type, round(regr_slope(v, i),8) AS slope FROM r GROUP BY 1")
def slope(spark, d):
    r = A.ranked(table(spark, d, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"])
    return r.groupBy("event_type").agg(F.round(A.slope("value", "_i"), 8).alias("slope"))


@query("win08_lag", "WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) SELECT user_id, round(avg(gap)/1e6,3) AS mean_gap FROM g GROUP BY 1")
def lag(spark, d):
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.round(F.avg("gap") / 1e6, 3).alias("mean_gap"))


@query("win10_pairs", "SELECT o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS diff, round(o_totalprice / lead(o_totalprice) OVER w, 4) AS ratio FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def pairs(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.lag("o_totalprice").over(w), 2).alias("diff"), F.round(F.col("o_totalprice") / F.lead("o_totalprice").over(w), 4).alias("ratio"))


@query("srt02_04_top", "SELECT lang, source, n FROM (SELECT lang, source, count(*) n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) r FROM documents GROUP BY 1,2) WHERE r <= 5")
def top(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).filter("r <= 5").drop("r")


@query("srt05_severity", "SELECT event_id, CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS severity FROM events ORDER BY severity DESC, event_id LIMIT 50")
def severity(spark, d):
    s = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return table(spark, d, "events").select("event_id", s.alias("severity")).orderBy(F.desc("severity"), "event_id").limit(50)


@query("sql01_08_statements", """
SELECT 'open' AS what, count(*) AS n FROM orders WHERE o_orderstatus='O' UNION ALL SELECT 'like', count(*) FROM part WHERE p_name LIKE '%1' UNION ALL SELECT 'between', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1994-06-30'
UNION ALL SELECT 'urgent_updated', count(*) FROM orders WHERE o_orderpriority='1-URGENT' AND o_orderstatus='O' UNION ALL SELECT 'expired', count(*) FROM orders WHERE o_orderdate <= TIMESTAMP '1993-01-01'""")
def statements(spark, d):
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    n = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    parts = [n(o.filter("o_orderstatus = 'O'"), "open"), n(p.filter(F.col("p_name").like("%1")), "like"), n(o.filter("o_orderdate between timestamp'1994-01-01' and timestamp'1994-06-30'"), "between"), n(o.filter("o_orderpriority = '1-URGENT' and o_orderstatus = 'O'"), "urgent_updated"), n(o.filter("o_orderdate <= timestamp'1993-01-01'"), "expired")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("sql03_06_latest", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def latest(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


@query("sql14_15_violations", """
SELECT 'duplicate_order' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'orphan_label', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'negative_balance', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0""")
def violations(spark, d):
    o, lab, docs, c = (table(spark, d, t) for t in ("orders", "labels", "documents", "customer"))
    rule = lambda df, name, key: df.select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key"))
    return rule(o.groupBy("o_orderkey").count().filter("count > 1"), "duplicate_order", "o_orderkey").union(rule(lab.join(docs, "doc_id", "left_anti"), "orphan_label", "doc_id")).union(rule(c.filter("c_acctbal < 0"), "negative_balance", "c_custkey"))
