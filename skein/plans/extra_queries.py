"""Reports, answer quality, expansion, exports and folds over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import scoring as S
from skein.functions import text as X
from skein.operators import folds
from skein.operators import retrieval as R
from skein.operators import scans as SC
from skein.plans.registry import query, table

_W = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


@query("agg16_store_operations", "SELECT event_type AS operation, user_id%3 AS store, count(*) AS n, round(sum(value),4) AS docs, round(avg(value),6) AS avg_docs, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2")
def operations(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("operation"), (F.col("user_id") % 3).alias("store")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("docs"), F.round(F.avg("value"), 6).alias("avg_docs"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("prj08_prompt_context", """WITH t AS (SELECT lang, doc_id, 'Source ('||source||'):'||chr(10)||substr(text,1,300) AS part FROM documents), r AS (SELECT *, sum(length(part)+2) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) u FROM t)
SELECT lang, md5(string_agg(part, chr(10)||chr(10) ORDER BY doc_id)) AS context FROM r WHERE u <= 5000 GROUP BY 1""")
def prompt(spark, d):
    part = F.concat(F.lit("Source ("), F.col("source"), F.lit("):\n"), F.substring("text", 1, 300))
    t = table(spark, d, "documents").select("lang", "doc_id", part.alias("part")).withColumn("cost", F.length("part") + 2)
    kept = R.within_budget(t, ["lang"], ["doc_id"], "cost", 5000).filter("used <= 5000")
    # The budget bounds what is gathered for a prompt.
    ordered = F.array_sort(F.collect_list(F.struct("doc_id", "part")))
    return kept.groupBy("lang").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n")).alias("context"))


@query("exp01_synonyms", "SELECT item_id, list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text),'{h}') THEN replace(lower(text),'{h}','{o}') END" for h, os in R.SYNONYMS.items() for o in os) + "], lambda x: x IS NOT NULL), 1, 3) AS variants FROM benchmark")
def synonyms(spark, d):
    return table(spark, d, "benchmark").select("item_id", R.expand_synonyms(F.col("text")).alias("variants"))


@query("exp03_context", "SELECT item_id, 'Information about '||lower(trim(text)) AS first FROM benchmark WHERE NOT regexp_matches(lower(trim(text)), '^(" + "|".join(R.QUESTION_HEADS) + ")')")
def context(spark, d):
    t = table(spark, d, "benchmark").filter(~F.lower(F.trim("text")).rlike("^(" + "|".join(R.QUESTION_HEADS) + ")"))
    return t.select("item_id", R.expand_context(F.col("text"))[0].alias("first"))


@query("sco05_document_time", "SELECT event_id, coalesce(try_strptime(a,'%Y-%m-%d %H:%M:%S'), try_strptime(b,'%Y-%m-%d')) AS at FROM (SELECT event_id, CASE WHEN event_id%3=0 THEN 'unknown' ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END a, strftime(ts,'%Y-%m-%d') b FROM events)")
def document_time(spark, d):
    a = F.when(F.col("event_id") % 3 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_to_timestamp(a, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd"), F.lit("yyyy-MM-dd"))).alias("at"))


@query("sco08_11_boosts", "WITH s AS (SELECT doc_id, lang, least(1.0, least(0.6, n_chars/8000.0)*CASE WHEN n_chars>2000 THEN 1.5 ELSE 1 END*CASE WHEN lang='en' THEN 1.3 ELSE 1 END) s FROM documents) SELECT lang, round(avg(s),6) AS avg, round(max(s),6) AS max, round(min(s),6) AS min, round(stddev_pop(s),6) AS std FROM s GROUP BY 1")
def boosts(spark, d):
    s = S.boosted(F.least(F.lit(0.6), F.col("n_chars") / 8000.0), [(F.col("n_chars") > 2000, 1.5), (F.col("lang") == "en", 1.3)])
    t = table(spark, d, "documents").select("lang", s.alias("s"))
    return t.groupBy("lang").agg(*[F.round(f("s"), 6).alias(n) for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop))])


@query("fun17_tagged_bytes", "SELECT doc_id, md5(to_base64(encode(text))) AS encoded, true AS same FROM documents")
def tagged(spark, d):
    e = F.base64(F.encode("text", "UTF-8"))
    # Line breaks of the MIME form are left out.
    return table(spark, d, "documents").select("doc_id", F.md5(F.regexp_replace(e, r"\r\n", "")).alias("encoded"), (F.decode(F.unbase64(e), "UTF-8") == F.col("text")).alias("same"))


@query("fun18_classes", "SELECT k AS class, count(*) AS n FROM (SELECT unnest([CASE WHEN regexp_matches(text,'[0-9]{4,}') THEN 'number' END, CASE WHEN regexp_matches(text,'https?://') THEN 'url' END, CASE WHEN regexp_matches(text,'[A-Z]{3,}') THEN 'capitals' END]) AS k FROM documents) WHERE k IS NOT NULL GROUP BY 1")
def classes(spark, d):
    named = {"number": "[0-9]{4,}", "url": "https?://", "capitals": "[A-Z]{3,}"}
    k = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in named.items()]))
    return table(spark, d, "documents").select(F.explode(k).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("fun25_coherence", f"WITH a AS (SELECT conv_id, turn, text, len({_W.format('text')}) w, len(list_filter(string_split_regex(text,'[.!?]+'), lambda s: trim(s)<>'')) n FROM conversations WHERE role='assistant') SELECT conv_id, turn, round(0.6*least((CAST(contains(lower(text),'the') AS INT)+CAST(contains(lower(text),'und') AS INT))/5,1)+0.4*least(CASE WHEN n>0 THEN w/n ELSE 0 END/20,1),6) AS coherence FROM a")
def coherence(spark, d):
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.round(X.coherence(F.col("text"), ["the", "und"]), 6).alias("coherence"))


@query("evt06_search_patterns", f"SELECT count(*) AS queries, count(DISTINCT text) AS unique_queries, round(avg(len({_W.format('text')})),6) AS mean_words, max(length(text)) AS longest FROM conversations WHERE role='user'")
def patterns(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("text").alias("unique_queries"), F.round(F.avg(F.size(X.words(F.col("text")))), 6).alias("mean_words"), F.max(F.length("text")).alias("longest"))


@query("evt09_personalisation", "WITH u AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) s, count(*) q, count(DISTINCT event_type) t, avg(value)/20 v FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN s>5 THEN 0.2 ELSE 0 END+CASE WHEN q>20 THEN 0.2 ELSE 0 END+CASE WHEN t>2 THEN 0.3 ELSE 0 END+CASE WHEN v>0.6 THEN 0.3 ELSE 0 END,4) AS score FROM u")
def personalisation(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("s"), F.count(F.lit(1)).alias("q"), F.countDistinct("event_type").alias("t"), (F.avg("value") / 20).alias("v"))
    part = lambda test, w: F.when(test, w).otherwise(0.0)
    return u.select("user_id", F.round(part(F.col("s") > 5, 0.2) + part(F.col("q") > 20, 0.2) + part(F.col("t") > 2, 0.3) + part(F.col("v") > 0.6, 0.3), 4).alias("score"))


@query("evt22_content_gaps", "SELECT source, count(*) AS n, round(avg(quality),6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING avg(quality) < 0.9 ORDER BY 3, 1 LIMIT 20")
def gaps(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    g = j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.avg("quality").alias("q"))
    return g.filter("q < 0.9").orderBy("quality", "source").limit(20).drop("q")


@query("evt41_kpis", "SELECT count(*) FILTER (event_type='purchase') AS purchases, round(sum(value) FILTER (event_type='purchase'),4) AS revenue, round(avg(value),6) AS mean, max(value) AS most, count(DISTINCT user_id) AS users, round(avg(CAST(event_type='error' AS INT)),6) AS error_rate FROM events")
def kpis(spark, d):
    bought = F.col("event_type") == "purchase"
    return table(spark, d, "events").agg(F.count(F.when(bought, 1)).alias("purchases"), F.round(F.sum(F.when(bought, F.col("value"))), 4).alias("revenue"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"), F.countDistinct("user_id").alias("users"), F.round(F.avg((F.col("event_type") == "error").cast("int")), 6).alias("error_rate"))


@query("evt42_activity_summary", "SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS activities FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1,2) WHERE r <= 3 GROUP BY 1")
def activity(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("r <= 3")
    return top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "event_type"))), lambda x: x["event_type"]), ",").alias("activities"))


@query("evt47_throughput", "SELECT event_type, round(1/avg(value),8) AS throughput, CASE WHEN avg(value)>12 THEN 'bottleneck' ELSE 'ok' END AS state FROM events WHERE value > 0 GROUP BY 1")
def throughput(spark, d):
    return table(spark, d, "events").filter("value > 0").groupBy("event_type").agg(F.round(1 / F.avg("value"), 8).alias("throughput"), F.when(F.avg("value") > 12, "bottleneck").otherwise("ok").alias("state"))


@query("evt49_retention", "WITH m AS (SELECT max(ts) t FROM events) SELECT hour(ts) AS hour, count(*) AS n, round(avg(value),6) AS latency FROM events, m WHERE ts > t - INTERVAL 7 DAY GROUP BY 1")
def retention(spark, d):
    e = table(spark, d, "events")
    t = e.join(F.broadcast(e.agg(F.max("ts").alias("t")))).filter(F.col("ts") > F.col("t") - F.expr("INTERVAL 7 DAYS"))
    return t.groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("latency"))


@query("str08_alert_history", "WITH m AS (SELECT max(ts) t FROM events) SELECT user_id, count(*) FILTER (ts > t - INTERVAL 24 HOUR) AS day, count(*) FILTER (ts > t - INTERVAL 7 DAY) AS week FROM events, m WHERE event_type='error' GROUP BY 1")
def alert_history(spark, d):
    e = table(spark, d, "events")
    t = e.filter("event_type = 'error'").join(F.broadcast(e.agg(F.max("ts").alias("t"))))
    within = lambda what: F.count(F.when(F.col("ts") > F.col("t") - F.expr(f"INTERVAL {what}"), 1))
    return t.groupBy("user_id").agg(within("24 HOURS").alias("day"), within("7 DAYS").alias("week"))


@query("str06_alert_rule", """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 f AS (SELECT e.event_id, user_id, i, CASE WHEN bad THEN 'raised' ELSE 'quiet' END AS state, bad AS active, CASE WHEN bad THEN [t] ELSE []::BIGINT[] END AS raised FROM e WHERE i = 1
  UNION ALL SELECT g.event_id, g.user_id, g.i, g.state, CASE WHEN g.state = 'raised' THEN true WHEN NOT bad THEN false ELSE active END, CASE WHEN g.state = 'raised' THEN list_append(log, t) ELSE log END
  FROM (SELECT h.*, CASE WHEN NOT bad AND active THEN 'resolved' WHEN NOT bad THEN 'quiet' WHEN active OR len(log) >= 5 OR (len(log) > 0 AND t - log[len(log)] < 300000000) THEN 'suppressed' ELSE 'raised' END AS state
   FROM (SELECT e.event_id, e.user_id, e.i, e.t, e.bad, f.active, list_filter(f.raised, lambda x: x > e.t - 3600000000) AS log FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) h) g)
SELECT event_id, user_id, state FROM f""")
def alert_rule(spark, d):
    return SC.alert_rule(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type = 'error'")


@query("snk14_metrics_text", "SELECT 'events_total{type=\"'||event_type||'\"} '||CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type")
def metrics_text(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.concat(F.lit('events_total{type="'), F.col("event_type"), F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("cac08_10_performance", "WITH r AS (SELECT user_id, avg(CAST(event_type='view' AS INT)) h, avg(CAST(event_type='error' AS INT)) e, least(1.0,avg(value)/20) q FROM events GROUP BY 1) SELECT user_id, round(0.5*h+0.3*q+0.2*(1-e),6) AS score FROM r")
def performance(spark, d):
    share = lambda kind: F.avg((F.col("event_type") == kind).cast("int"))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(0.5 * share("view") + 0.3 * F.least(F.lit(1.0), F.avg("value") / 20) + 0.2 * (1 - share("error")), 6).alias("score"))


@query("chk11_14_semantic_chunks")
def semantic(spark, d):
    return folds.semantic_chunks(table(spark, d, "documents"), "doc_id", "text", 0.3)


@query("chk18_hierarchical_chunks")
def hierarchical(spark, d):
    return folds.hierarchical_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("hyb01_02_folded_keywords", """WITH w AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'that')) AS w FROM benchmark),
 a AS (SELECT item_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS k FROM w) SELECT item_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS keywords FROM a""")
def folded(spark, d):
    return folds.folded_keywords(table(spark, d, "benchmark"), "item_id", "text", ["the", "and", "that"])
