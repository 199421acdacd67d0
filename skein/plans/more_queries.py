"""Further queries: projections, validation, expansion, topics, reports, caches and approximate search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import scoring as S
from skein.functions import text as X
from skein.operators import analytics as E
from skein.operators import chunkers as C
from skein.operators import documents as D
from skein.operators import retrieval as R
from skein.operators import neighbours as N
from skein.operators import vectors as V
from skein.plans.registry import query, table
from skein.sources import html as H
from skein.sources import logs as L

_W = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


@query("src06_html_normalise", "SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text,'\\r\\n?',chr(10),'g'),chr(10)), lambda l: trim(l)),chr(10)),'\\n{3,}',chr(10)||chr(10),'g'))) AS m FROM documents")
def normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(H.normalised(F.col("text"))).alias("m"))


@query("src10_html_images", """SELECT page_id, len(list_filter(regexp_extract_all(html,'(?i)<img\\s[^>]*src="([^"]+)"',1), lambda s: NOT starts_with(s,'data:'))) AS images FROM pages""")
def images(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(H.images(F.col("html"))).alias("images"))


@query("src12_heading_markers", "SELECT page_id, len(regexp_extract_all(html,'(?is)<h1[^>]*>.*?</h1>')) AS n FROM pages")
def markers(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_count(H.marked_headings(F.col("html")), F.lit("(?m)^# ")).alias("n"))


@query("src16_markdown_normalise", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text,'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]','','g'),'[ \\t]+',' ','g'),'\\s*\\n\\s*',chr(10),'g'))) AS m FROM documents")
def markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(H.markdown_text(F.col("text"))).alias("m"))


@query("src26_validation", """SELECT page_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(url,'^https?://') THEN 'scheme' END, CASE WHEN regexp_matches(url,'^https?://([^/:?#]+\\.)?example\\.net([/:?#]|$)') THEN 'domain' END, CASE WHEN length(url)>2048 THEN 'length' END], lambda x: x IS NOT NULL),',') AS problems FROM pages""")
def validation(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(D.validate_url(F.col("url"), ["example.net"]), ",").alias("problems"))


@query("src29_point_lookup", "SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 99, 123456789)")
def lookup(spark, d):
    return table(spark, d, "documents").filter(F.col("doc_id").isin(1, 5, 99, 123456789)).select("doc_id", "lang")


@query("src30_log_lines", "SELECT event_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level, user_id AS line, event_type||' '||props AS message FROM events WHERE value >= 1")
def log_lines(spark, d):
    """Events as lines of a log, read back; small ones are written without a layout and give no row."""
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    made = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), level, F.lit("  | app:run:"), F.col("user_id").cast("string"), F.lit(" | "), F.col("event_type"), F.lit(" "), F.col("props"))
    line = F.when(F.col("value") < 1, F.concat(F.lit("value "), F.col("value").cast("string"))).otherwise(made)
    parsed = table(spark, d, "events").select("event_id", L.parse(line).alias("x")).filter("x is not null")
    return parsed.select("event_id", "x.level", F.col("x.line").cast("long").alias("line"), "x.message")


@query("prj01_03_citations", "SELECT doc_id, source || CASE WHEN doc_id%3=0 THEN ' (page '||CAST(doc_id%7 AS VARCHAR)||')' WHEN doc_id%3=1 THEN ' (slide '||CAST(doc_id%5 AS VARCHAR)||')' ELSE '' END AS reference, CAST(doc_id AS VARCHAR)||'_chunk_'||CAST(doc_id%4 AS VARCHAR) AS chunk_id, 'caller' AS winner, substr(text,1,100)||'...' AS preview FROM documents")
def citations(spark, d):
    i = F.col("doc_id")
    t = table(spark, d, "documents").withColumn("i", (i % 4).cast("int"))
    entry = lambda v: F.create_map(F.lit("owner"), F.lit(v))
    t = t.withColumn("m", D.chunk_metadata("doc_id", "i", entry("chunk"), entry("caller")))
    return t.select("doc_id", D.reference(F.col("source"), F.when(i % 3 == 0, i % 7), F.when(i % 3 == 1, i % 5)).alias("reference"), F.col("m")["chunk_id"].alias("chunk_id"), F.col("m")["owner"].alias("winner"), D.preview(F.col("text")).alias("preview"))


@query("snk02_04_upsert", "SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN c_acctbal+1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey%3=0 THEN 2 ELSE 0 END AS version FROM customer")
def upsert(spark, d):
    store = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("version"))
    change = store.filter("c_custkey % 3 = 0")
    batch = change.withColumns({"version": F.lit(1)}).unionByName(change.withColumns({"version": F.lit(2), "c_acctbal": F.col("c_acctbal") + 1}))
    return D.upsert(store, batch, "c_custkey")


@query("hyb03_store_keywords", f"WITH t AS (SELECT item_id, {_W.format('lower(text)')} w FROM benchmark), u AS (SELECT item_id, unnest(w) k, unnest(range(1,len(w)+1)) i FROM t), f AS (SELECT item_id, k, min(i) i FROM u WHERE length(k) > 2 GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) n FROM f) SELECT item_id, string_agg(k, ' ' ORDER BY n) AS keywords FROM r WHERE n <= 16 GROUP BY 1")
def keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.keywords(F.col("text")), " ").alias("keywords"))


@query("hyb14_retrieve", """WITH p AS (SELECT q.vec_id qid, r.vec_id id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]),9) s FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) k FROM p)
SELECT qid AS query_id, id, round(0.7*s+0.3*(CASE WHEN n_chars BETWEEN 500 AND 4000 THEN 0.5 ELSE 0.25 END + CASE WHEN lang='en' THEN 0.5 ELSE 0.25 END),6) AS score FROM r JOIN documents ON doc_id = id WHERE k <= 5 AND s >= 0.25""")
def retrieve(spark, d):
    e = table(spark, d, "embeddings")
    top = V.batch_topk(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).filter("score >= 0.25 and rank <= 5")
    meta = F.when(F.col("n_chars").between(500, 4000), 0.5).otherwise(0.25) + F.when(F.col("lang") == "en", 0.5).otherwise(0.25)
    told = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), meta.alias("meta")), "id")
    return told.select("query_id", "id", F.round(S.combined(F.col("score"), F.col("meta"), 0.3), 6).alias("score"))


@query("rrk04_metadata_score", """
WITH p AS (SELECT page_id, html, len(regexp_extract_all(html, '(?i)<h[1-6][^>]*>')) AS h, len(regexp_extract_all(html, '(?i)<a\\s[^>]*href=')) AS l, len(regexp_extract_all(html, '(?i)<table[^>]*>')) AS t,
 len(list_filter(string_split_regex(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS n FROM pages)
SELECT page_id, round(greatest(0, least(1, 0.05 + least(h * 0.02, 0.1) + least(l * 0.01, 0.05) + least(t * 0.03, 0.1) + CASE WHEN n BETWEEN 100 AND 800 THEN 0.1 WHEN n BETWEEN 50 AND 1500 THEN 0.05 ELSE 0 END
 + CASE WHEN regexp_matches(html, '\\d{4}-\\d{2}-\\d{2}') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)<html[^>]*\\blang="[^"]+"') THEN 0.05 ELSE 0 END)), 6) AS score FROM p""")
def metadata_score(spark, d):
    """Pages by what their own markup tells."""
    html = F.col("html")
    words = F.size(F.filter(F.split(F.regexp_replace(html, "<[^>]*>", " "), r"\s+"), lambda x: x != ""))
    count = lambda pattern: F.regexp_count(html, F.lit(pattern))
    told = D.metadata_score(F.lit("html"), count(r"(?i)<h[1-6][^>]*>"), count(r"(?i)<a\s[^>]*href="), count(r"(?i)<table[^>]*>"), words, html.rlike(r"\d{4}-\d{2}-\d{2}"), html.rlike(r'(?i)<html[^>]*\blang="[^"]+"'))
    return table(spark, d, "pages").select("page_id", F.round(told, 6).alias("score"))


@query("vec05_06_bucketed_search")
def bucketed(spark, d):
    """Ten neighbours of each query: the vectors have no clusters, so most lists are probed, and signatures tell which rows
    of these are compared."""
    e = table(spark, d, "embeddings")
    return N.search(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query("vec05_06_measured")
def bucketed_measured(spark, d):
    """Recall against the exact search, and the share of all rows that a query was compared with."""
    e = table(spark, d, "embeddings")
    return N.measured(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query("jon10_siblings", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders")
def siblings(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey")).alias("best"))


@query("win06_09_growth", "WITH c AS (SELECT user_id, CAST(ts AS DATE) AS dd, count(*) AS n FROM events GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY dd DESC) b, count(*) OVER (PARTITION BY user_id) m FROM c), g AS (SELECT user_id, max(m) m, sum(n) FILTER (b<=4) a, coalesce(sum(n) FILTER (b BETWEEN 5 AND 8),0) p FROM r GROUP BY 1) SELECT user_id, round(CASE WHEN m<4 THEN 0 WHEN p=0 THEN 100 ELSE 100.0*(a-p)/p END,4) AS growth FROM g")
def growth(spark, d):
    c = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    r = c.withColumns({"b": F.row_number().over(w.orderBy(F.desc("day"))), "m": F.count(F.lit(1)).over(w)})
    g = r.groupBy("user_id").agg(F.max("m").alias("m"), F.sum(F.when(F.col("b") <= 4, F.col("n"))).alias("a"), F.coalesce(F.sum(F.when(F.col("b").between(5, 8), F.col("n"))), F.lit(0)).alias("p"))
    return g.select("user_id", F.round(F.when(F.col("m") < 4, 0.0).when(F.col("p") == 0, 100.0).otherwise(100.0 * (F.col("a") - F.col("p")) / F.col("p")), 4).alias("growth"))


@query("chk07_08_clean_clamp", f"SELECT doc_id, md5(array_to_string({_W.format('text')}[1:50],' ')) AS clamped FROM documents")
def clamp(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.word_prefix(F.col("text"), 50)).alias("clamped"))


@query("chk15_16_titles", "SELECT doc_id, regexp_extract(text,'(?m)^#\\s+(.+)$',1) AS title, len(regexp_extract_all(text,'(?m)^##+\\s+(.+)$',1)) AS sections FROM documents")
def titles(spark, d):
    return table(spark, d, "documents").select("doc_id", C.document_title(F.col("text")).alias("title"), F.size(C.section_titles(F.col("text"))).alias("sections"))


@query("chk03_boundary", "WITH h AS (SELECT doc_id, text c FROM documents), e AS (SELECT doc_id, c, regexp_extract(c,'(?s)^(.*[.!?。！？؟؛،])(?:\\s|$)',1) h FROM h) SELECT doc_id, length(CASE WHEN length(h) > 0.7*length(c) THEN h ELSE c END) AS n FROM e")
def boundary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(C.boundary_trim(F.col("text"))).alias("n"))


@query("fun15_threat", "SELECT doc_id, round(CASE WHEN length(text)>1000 THEN 0.3 ELSE 0 END+CASE WHEN contains(lower(text),'idiot') THEN 0.5 ELSE 0 END+CASE WHEN regexp_matches(text,'[0-9]{6,}') THEN 0.4 ELSE 0 END,4) AS score FROM documents")
def threat(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.threat_score(F.col("text"), ["idiot"], ["[0-9]{6,}"]), 4).alias("score"))


@query("fun13_financial", "SELECT doc_id, len(regexp_extract_all(text,'[0-9]+(\\.[0-9]+)?%')) AS percents, len(regexp_extract_all(text,'\\$[0-9]+')) AS amounts, len(regexp_extract_all(text,'[0-9]+(\\.[0-9]+)?')) AS numbers FROM documents")
def financial(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return table(spark, d, "documents").select("doc_id", n(r"[0-9]+(\.[0-9]+)?%").alias("percents"), n(r"\$[0-9]+").alias("amounts"), n(r"[0-9]+(\.[0-9]+)?").alias("numbers"))


@query("fun19_date_parts", "SELECT event_id, hour(ts) AS hour, isodow(ts)-1 AS weekday, strftime(ts,'%Y-%m-%d') AS day FROM events")
def date_parts(spark, d):
    return table(spark, d, "events").select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("evt04_topics", f"WITH t AS (SELECT c.conv_id, unnest({_W.format('lower(text)')}) k FROM conversations c WHERE role='user'), n AS (SELECT conv_id, k, count(*) n FROM t WHERE length(k) > 3 AND k NOT IN ('with','that','this','from') GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, k) i FROM n) SELECT conv_id, k AS topic, n FROM r WHERE i <= 5")
def topics(spark, d):
    t = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", F.explode(X.words(F.lower("text"))).alias("topic")).filter((F.length("topic") > 3) & ~F.col("topic").isin("with", "that", "this", "from"))
    n = t.groupBy("conv_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "topic"))).filter("i <= 5").drop("i")


@query("evt27_threshold_anomalies", """
WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS kinds, max(value) AS slow, avg(CAST(event_type='error' AS INT)) AS errors FROM events GROUP BY 1,2),
 x AS (SELECT *, 100.0*n/max(n) OVER (PARTITION BY day) AS cpu, 100.0*kinds/5 AS memory FROM h),
 a AS (SELECT user_id, day, 'cpu' AS kind, CASE WHEN cpu>90 THEN 'critical' WHEN cpu>80 THEN 'high' END AS severity FROM x UNION ALL SELECT user_id, day, 'memory', CASE WHEN memory>95 THEN 'critical' WHEN memory>85 THEN 'high' END FROM x
  UNION ALL SELECT user_id, day, 'latency', CASE WHEN slow>50 THEN 'critical' WHEN slow>20 THEN 'high' END FROM x UNION ALL SELECT user_id, day, 'errors', CASE WHEN errors>0.1 THEN 'critical' WHEN errors>0.05 THEN 'high' END FROM x)
SELECT * FROM a WHERE severity IS NOT NULL""")
def threshold_anomalies(spark, d):
    """A user's day: load against the day's busiest, kinds in use, the slowest event, the share of errors."""
    h = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("kinds"), F.max("value").alias("slow"), F.avg((F.col("event_type") == "error").cast("int")).alias("errors"))
    busiest = h.groupBy("day").agg(F.max("n").alias("most"))
    grade = lambda kind, c, high, mid: F.struct(F.lit(kind).alias("kind"), F.when(c > high, "critical").when(c > mid, "high").alias("severity"))
    kinds = F.array(grade("cpu", 100.0 * F.col("n") / F.col("most"), 90, 80), grade("memory", 100.0 * F.col("kinds") / 5, 95, 85), grade("latency", F.col("slow"), 50, 20), grade("errors", F.col("errors"), 0.1, 0.05))
    return h.join(busiest, "day").select("user_id", "day", F.inline(kinds)).filter("severity is not null")


@query("evt34_security_report", "WITH u AS (SELECT user_id, count(*) FILTER (event_type='error') f, count(*) n FROM events GROUP BY 1) SELECT user_id, f AS failures, least(100, CASE WHEN f>20 THEN 40 WHEN f>10 THEN 20 ELSE 0 END + CASE WHEN f/n>0.3 THEN 30 WHEN f/n>0.15 THEN 15 ELSE 0 END) AS risk FROM u")
def security(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("failures"), F.count(F.lit(1)).alias("n"))
    share = F.col("failures") / F.col("n")
    return u.select("user_id", "failures", F.least(F.lit(100), F.when(F.col("failures") > 20, 40).when(F.col("failures") > 10, 20).otherwise(0) + F.when(share > 0.3, 30).when(share > 0.15, 15).otherwise(0)).alias("risk"))


@query("evt37_policies", "SELECT doc_id, CASE WHEN n_chars > 5000 THEN 'summarise' WHEN lang='en' THEN 'allow' ELSE 'review' END AS action FROM documents")
def policies(spark, d):
    p = spark.createDataFrame([(None, 5000, 3, "summarise"), ("en", None, 2, "allow"), (None, None, 1, "review")], "policy_tier string, over_length long, priority int, action string")
    return D.policy(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), p, "lang", "n_chars").select("doc_id", "action")


@query("evt39_log_report", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(100.0*count(*) FILTER (event_type='error')/count(*),4) AS error_percent, round(avg(value),4) AS mean FROM events GROUP BY 1")
def log_report(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(n.alias("n"), F.round(100.0 * F.count(F.when(F.col("event_type") == "error", 1)) / n, 4).alias("error_percent"), F.round(F.avg("value"), 4).alias("mean"))


@query("evt46_model_rates", "WITH m AS (SELECT lang AS model, l.quality * 1.0 AS quality, least(1.0, n_chars / 2000.0) AS confidence FROM documents JOIN labels l USING (doc_id)) SELECT model, count(*) AS n, round(avg(confidence),6) AS confidence, round(avg(quality),6) AS quality, round(avg(CAST(confidence>0.8 AND quality>0.7 AS INT)),6) AS high_quality, round(avg(CAST(confidence<0.5 AS INT)),6) AS low_confidence FROM m GROUP BY 1")
def model_rates(spark, d):
    """By language as model: the labelled quality, and confidence that grows with the text."""
    m = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("model"), F.col("quality").cast("double").alias("quality"), F.least(F.lit(1.0), F.col("n_chars") / 2000.0).alias("confidence"))
    share = lambda test: F.round(F.avg(test.cast("int")), 6)
    return m.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("quality"), 6).alias("quality"), share((F.col("confidence") > 0.8) & (F.col("quality") > 0.7)).alias("high_quality"), share(F.col("confidence") < 0.5).alias("low_confidence"))


@query("evt50_rapid_fire", "WITH g AS (SELECT user_id, epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) g FROM events) SELECT user_id, round(0.1*count(*) FILTER (g < 60000000)/count(*),8) AS score FROM g GROUP BY 1")
def rapid_fire(spark, d):
    t = E.micros(F.col("ts"))
    g = table(spark, d, "events").select("user_id", (t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("g"))
    return g.groupBy("user_id").agg(F.round(0.1 * F.count(F.when(F.col("g") < 60_000_000, 1)) / F.count(F.lit(1)), 8).alias("score"))


@query("cac02_07_admission", "WITH c AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) age, count(*) OVER (PARTITION BY user_id) n FROM events WHERE value > 5) SELECT event_id FROM c WHERE age > greatest(1, n//10)")
def admission(spark, d):
    w = Window.partitionBy("user_id")
    c = table(spark, d, "events").filter("value > 5").withColumns({"age": F.row_number().over(w.orderBy("ts", "event_id")), "n": F.count(F.lit(1)).over(w)})
    return c.filter(F.col("age") > F.greatest(F.lit(1), F.floor(F.col("n") / 10))).select("event_id")


@query("cac11_strategies", """WITH w AS (SELECT doc_id, n_chars, list_filter(string_split_regex(lower(text),'\\s+'), lambda x: x<>'') AS ws FROM documents), c AS (SELECT doc_id, n_chars, round(CASE WHEN len(ws)=0 THEN 0 ELSE len(list_distinct(ws))/len(ws) END, 9) AS c FROM w)
SELECT doc_id, (n_chars>10) AS exact_, c>=0.7 AS semantic, (n_chars>10 AND c>=0.6) AS fuzzy, CAST(n_chars>10 AS INT)+CAST(c>=0.7 AS INT)+CAST(n_chars>10 AND c>=0.6 AS INT)>=2 AS hybrid FROM c""")
def strategies(spark, d):
    """Which strategies keep a text; how sure one is of it is the share of different words."""
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    t = table(spark, d, "documents").select("doc_id", "n_chars", w.alias("w"))
    c, long_ = F.round(F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.array_distinct("w")) / F.size("w")), 9), F.col("n_chars") > 10
    parts = [long_, c >= 0.7, long_ & (c >= 0.6)]
    return t.select("doc_id", parts[0].alias("exact_"), parts[1].alias("semantic"), parts[2].alias("fuzzy"), (sum((p.cast("int") for p in parts), F.lit(0)) >= 2).alias("hybrid"))


@query("cac12_stability", "SELECT user_id, round(1-least(stddev_pop(value)/avg(value),1),6) AS stability FROM events GROUP BY 1")
def stability(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(1 - F.least(F.stddev_pop("value") / F.avg("value"), F.lit(1.0)), 6).alias("stability"))


@query("udf01_hooks", "SELECT lang, count(*) AS n FROM documents WHERE n_chars > 100 GROUP BY 1")
def hooks(spark, d):
    return D.with_hooks(table(spark, d, "documents"), [lambda df: df.filter("n_chars > 100"), lambda df: df.select("no_such_column"), lambda df: df.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))])
