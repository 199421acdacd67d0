"""Answers and their context, expansion by dictionaries, lexical and semantic search, numbers, alerts, sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.operators import answers as A
from skein.operators import retrieval as R
from skein.operators import vectors as V
from skein.plans.registry import query, table
from skein.sources import html as H
from skein.sources import texts as S

_W = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Questions in the dictionaries' language.
ASKED = ["یادگیری ماشین چیست", "چطور برنامه بنویسم", "داده و سیستم در کامپیوتر", "لطفا مشکل امنیت را بگو", "بگو کیفیت", "hello world", "", "کاربر کاربر"]
_ASKED = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(t)})" for i, t in enumerate(ASKED)) + ") v(id, q)"


def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "id int, q string")


_PAIRS = "WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS question FROM conversations a JOIN conversations b ON a.conv_id=b.conv_id AND b.turn=a.turn-1 WHERE a.role='assistant')"


def pairs(spark, d):
    """Answers with the turn before."""
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(before, ["conv_id", "turn"])


_HELD = lambda col, phrases: " + ".join(f"CAST(contains(lower({col}), {_q(p)}) AS INT)" for p in phrases)


@query("fun22_accuracy", f"""{_PAIRS} SELECT conv_id, turn, round(0.7*least(len({_W.format('answer')})/CASE WHEN len({_W.format('question')})<5 THEN 20 WHEN len({_W.format('question')})<10 THEN 50 ELSE 100 END,1)+0.3*({_HELD('answer', A.SOURCED)})/5,6) AS score FROM p""")
def accuracy(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(A.accuracy(F.col("answer"), F.col("question")), 6).alias("score"))


@query("fun26_factual_overlap", f"""WITH d AS (SELECT doc_id, regexp_replace(text,'[\\x{{C0}}-\\x{{24F}}]','_','g') AS t FROM documents), x AS (SELECT a.doc_id, a.t AS answer, regexp_extract_all(a.t,{_q(A.FACT)}) AS fa, regexp_extract_all(b.t,{_q(A.FACT)}) AS fb FROM d a JOIN d b ON b.doc_id=a.doc_id+1)
SELECT doc_id, round(CASE WHEN length(answer)=0 THEN 0 WHEN len(fb)=0 THEN 0.5 ELSE least(len(list_intersect(list_distinct(fa),list_distinct(fb)))/len(fb),1) END,6) AS score FROM x""")
def factual(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("context"))
    return docs.join(following, "doc_id").select("doc_id", F.round(A.factual_overlap(F.col("text"), F.col("context")), 6).alias("score"))


@query("fun27_confidence", f"""{_PAIRS} SELECT conv_id, turn, round(greatest(0,least(1,0.4*len(list_intersect(list_distinct({_W.format('lower(question)')}),list_distinct({_W.format('lower(answer)')})))/greatest(1,len(list_distinct({_W.format('lower(question)')})))+0.3*least(turn/5,1)+0.2*CASE WHEN len({_W.format('answer')})<5 THEN 0.3 WHEN len({_W.format('answer')})>200 THEN 0.8 ELSE 1 END+0.1*greatest(0.5,1-0.1*({_HELD('answer', A.DOUBT)})))),6) AS score FROM p""")
def confidence(spark, d):
    own = lambda c: F.array_distinct(A.word_list(F.lower(F.col(c))))
    quality = F.size(F.array_intersect(own("question"), own("answer"))) / F.greatest(F.lit(1), F.size(own("question")))
    return pairs(spark, d).select("conv_id", "turn", F.round(A.confidence(F.col("answer"), F.col("turn"), quality), 6).alias("score"))


@query("fun14_number_trends", f"WITH n AS (SELECT doc_id, list_transform(regexp_extract_all(text,{_q(A.NUMBER)}), lambda x: CAST(x AS DOUBLE)) AS v FROM documents) SELECT doc_id, round(list_avg(v),6) AS mean, round(list_median(v),6) AS median, CASE WHEN len(v)<5 THEN 'neutral' WHEN list_avg(v[-3:])>list_avg(v[:-4])*1.05 THEN 'bullish' WHEN list_avg(v[-3:])<list_avg(v[:-4])*0.95 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM n WHERE len(v)>=3")
def trends(spark, d):
    v = table(spark, d, "documents").select("doc_id", A.numbers(F.col("text")).alias("v")).filter(F.size("v") >= 3).withColumn("o", F.sort_array("v"))
    n = F.size("o")
    median = (F.get("o", F.floor((n - 1) / 2).cast("int")) + F.get("o", F.floor(n / 2).cast("int"))) / 2
    return v.select("doc_id", F.round(A.mean(F.col("v")), 6).alias("mean"), F.round(median, 6).alias("median"), A.sentiment(F.col("v")).alias("sentiment"))


@query("fun16_persian_digits", f"SELECT c_custkey, translate(c_name,'0123456789',{_q(A.PERSIAN_DIGITS)}) AS persian, translate(translate(c_name,'0123456789',{_q(A.PERSIAN_DIGITS)}),{_q(A.PERSIAN_DIGITS)},'0123456789')=c_name AS back FROM customer")
def digits(spark, d):
    persian = F.translate("c_name", "0123456789", A.PERSIAN_DIGITS)
    return table(spark, d, "customer").select("c_custkey", persian.alias("persian"), (F.translate(persian, A.PERSIAN_DIGITS, "0123456789") == F.col("c_name")).alias("back"))


_CATEGORY = "CASE " + " ".join("WHEN " + " OR ".join(f"starts_with(lower(q), {_q(h)})" for h in heads) + f" THEN '{name}'" for name, heads in A.CATEGORIES.items()) + " ELSE 'other' END"


@query("fun11_query_category", f"SELECT id, {_CATEGORY} AS category FROM ({_ASKED}) UNION ALL SELECT conv_id*100+turn+1000, {_CATEGORY} FROM (SELECT conv_id, turn, text AS q FROM conversations WHERE role='user')")
def categories(spark, d):
    own = asked(spark).select(F.col("id").cast("long").alias("id"), "q")
    turns = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn") + 1000).alias("id"), F.col("text").alias("q"))
    return own.unionByName(turns).select("id", A.category(F.col("q")).alias("category"))


@query("fun28_alert_conditions", """WITH m AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1,2)
SELECT l_returnflag, l_linestatus, quantity > 25 AND NOT (discount >= 0.05) OR n < 1000 AS a, 10 < n AND n <= 20000 AS b, quantity * 2 - 1 > 50.05 AS c, false AS d, false AS e FROM m""")
def alerts(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    rules = {"a": "quantity > 25 and not (discount >= 0.05) or n < 1000", "b": "10 < n <= 20000", "c": "quantity * 2 - 1 > 50.05", "d": "unknown > 1", "e": "__import__('os')"}
    return m.select("l_returnflag", "l_linestatus", *[A.alert(rule, ["n", "quantity", "discount"]).alias(name) for name, rule in rules.items()])


@query("hyb06_contains_search", f"""WITH t AS (SELECT item_id, {_W.format('lower(text)')} AS w FROM benchmark WHERE item_id % 50 = 0), k AS (SELECT item_id, list_filter(list_distinct(w), lambda x: length(x) > 2) AS ks FROM t),
 u AS (SELECT item_id, kw FROM (SELECT item_id, unnest(w) AS kw, unnest(range(1, len(w)+1)) AS i FROM t) WHERE length(kw) > 2 GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(i)) <= 8),
 s AS (SELECT item_id, doc_id, count(*) AS n FROM u JOIN documents ON contains(text, kw) GROUP BY 1,2)
SELECT item_id, doc_id, round(n / max(n) OVER (PARTITION BY item_id), 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) <= 20""")
def contains_search(spark, d):
    asked_ = table(spark, d, "benchmark").filter("item_id % 50 = 0").select("item_id", F.explode(F.slice(X.keywords(F.col("text"), 8), 1, 8)).alias("keyword"))
    # The stated queries, eight keywords each, in blocks: each text is searched once for all keywords of a block.
    blocks = max(1, -(-asked_.count() // 4096))
    block = asked_.groupBy(F.pmod(F.xxhash64("keyword"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("item_id", "keyword")).alias("asked"))
    texts = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    hits = texts.join(block, "block").select("doc_id", F.explode(F.filter("asked", lambda a: F.contains(F.col("text"), a["keyword"]))).alias("a"))
    n = hits.groupBy(F.col("a.item_id").alias("query_id"), F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    # The best is the first in rank.
    best = R.placed(n, [F.desc("n"), "id"], 20).withColumn("most", F.max("n").over(Window.partitionBy("query_id")))
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round(F.col("n") / F.col("most"), 6).alias("score"))


_NEAR = "p AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]),9) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS k FROM p)"


@query("hyb11_lexical_fusion", f"""WITH {_NEAR}, w AS (SELECT doc_id, list_distinct({_W.format('lower(text)')}) AS ws FROM documents), x AS (SELECT query_id, id, round(0.7*s+0.3*len(list_intersect(a.ws,b.ws))/greatest(1,len(a.ws)),6) AS score FROM r JOIN w a ON a.doc_id=query_id JOIN w b ON b.doc_id=id WHERE k <= 20)
SELECT query_id, id, score FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""")
def lexical_fusion(spark, d):
    e = table(spark, d, "embeddings")
    top = V.batch_topk(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 20)
    found = table(spark, d, "documents").select("doc_id", F.array_distinct(A.word_list(F.lower("text"))).alias("ws"))
    both = top.join(found.select(F.col("doc_id").alias("query_id"), F.col("ws").alias("asked")), "query_id").join(found.select(F.col("doc_id").alias("id"), "ws"), "id")
    share = F.size(F.array_intersect("asked", "ws")) / F.greatest(F.lit(1), F.size("asked"))
    scored = both.select("query_id", "id", F.round(0.7 * F.col("score") + 0.3 * share, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("rank <= 10").drop("rank")


@query("hyb15_by_embedding", f"WITH {_NEAR} SELECT query_id, id, round(s,6) AS score FROM r WHERE k <= 10 AND s >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 5")
def by_embedding(spark, d):
    e = table(spark, d, "embeddings")
    top = V.batch_topk(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return top.filter("score >= 0.3 and rank <= 5").select("query_id", "id", F.round("score", 6).alias("score"))


@query("vec18_confidence_filter", f"WITH {_NEAR} SELECT query_id, count(*) AS kept, round(avg(s),6) AS confidence FROM r WHERE k <= 10 AND s >= 0.5 GROUP BY 1")
def confidence_filter(spark, d):
    e = table(spark, d, "embeddings")
    top = V.batch_topk(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return top.filter("score >= 0.5").groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.avg("score"), 6).alias("confidence"))


@query("vec09_score_conversion", "WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id=0) SELECT vec_id, round(1-list_cosine_distance(embedding::DOUBLE[],v),6) AS cosine, round(0.0-list_distance(embedding::DOUBLE[],v),6) AS l2 FROM embeddings, q")
def score_conversion(spark, d):
    e = table(spark, d, "embeddings")
    one = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("v")))
    distance = 1 - V.cosine(F.col("embedding"), F.col("v"))
    return e.join(one).select("vec_id", F.round(1 - distance, 6).alias("cosine"), F.round(V.negative_l2(F.col("embedding"), F.col("v")) + 0.0, 6).alias("l2"))


@query("src02_is_path", "SELECT page_id, k, (contains(s,'/') OR contains(s,chr(92)) OR (regexp_matches(s,'\\.[\\p{L}\\p{N}]{1,10}$') AND NOT contains(s,' '))) AND length(s)<500 AS path FROM (SELECT page_id, 1 AS k, url AS s FROM pages UNION ALL SELECT page_id, 2, html FROM pages UNION ALL SELECT page_id, 3, replace(substr(url,9),'/','.') FROM pages UNION ALL SELECT page_id, 4, replace(substr(url,9),'/',' ') FROM pages)")
def is_path(spark, d):
    p = table(spark, d, "pages")
    host = F.expr("substr(url, 9)")
    kinds = [F.col("url"), F.col("html"), F.replace(host, F.lit("/"), F.lit(".")), F.replace(host, F.lit("/"), F.lit(" "))]
    rows = p.select("page_id", F.posexplode(F.array(*kinds)).alias("k", "s"))
    return rows.select("page_id", (F.col("k") + 1).alias("k"), S.is_path(F.col("s")).alias("path"))


@query("src14_url_metadata", """SELECT page_id, regexp_extract(html,'<html[^>]*\\slang="([^"]*)"',1) AS lang, regexp_extract(html,'(?is)<title[^>]*>(.*?)</title>',1) AS title, regexp_extract(html,'<link[^>]*rel="canonical"[^>]*href="([^"]*)"',1) AS canonical, regexp_extract(html,'<meta[^>]*name="description"[^>]*content="([^"]*)"',1) AS description, regexp_extract(html,'<meta[^>]*property="og:title"[^>]*content="([^"]*)"',1) AS og_title, regexp_extract(html,'<meta[^>]*name="robots"[^>]*content="([^"]*)"',1) AS robots FROM pages""")
def url_metadata(spark, d):
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in H.page_metadata(F.col("html")).items()])


@query("prj04_previews", "SELECT source, string_agg(substr(text,1,100)||'...', '|' ORDER BY doc_id) AS previews FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3) GROUP BY 1")
def previews(spark, d):
    # The three smallest ids of a source, by partial aggregates: no source is sorted in one task.
    docs = table(spark, d, "documents").select("source", "doc_id")
    first = None
    for _ in range(3):
        left = docs if first is None else docs.join(first, "source").filter(F.col("doc_id") > F.col("last")).select("source", "doc_id")
        one = left.groupBy("source").agg(F.min("doc_id").alias("last"))
        chosen = one.select("source", F.col("last").alias("doc_id")) if first is None else chosen.unionByName(one.select("source", F.col("last").alias("doc_id")))
        first = one
    shown = table(spark, d, "documents").join(chosen.select("doc_id"), "doc_id")
    return shown.groupBy("source").agg(F.expr("array_join(transform(sort_array(collect_list(struct(doc_id, concat(substr(text, 1, 100), '...') AS p))), x -> x.p), '|')").alias("previews"))


@query("prj06_token_truncate", f"SELECT doc_id, array_to_string({_W.format('text')}[:50], ' ') AS head, least(50, len({_W.format('text')})) AS tokens FROM documents")
def token_truncate(spark, d):
    own = A.word_list(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(own, 1, 50), " ").alias("head"), F.least(F.lit(50), F.size(own)).alias("tokens"))


TEMPLATE = "Answer {question} in {language}. Sources: {sources}. {missing}"


@query("prj09_prompt_templates", f"SELECT doc_id, md5(replace(replace(replace({_q(TEMPLATE)},'{{question}}',text),'{{language}}',lang),'{{sources}}',source)) AS prompt, 'question,language,sources,missing' AS variables FROM documents")
def prompts(spark, d):
    filled = S.filled(TEMPLATE, {"question": F.col("text"), "language": F.col("lang"), "sources": F.col("source")})
    return table(spark, d, "documents").select("doc_id", F.md5(filled).alias("prompt"), F.array_join(S.variables(F.lit(TEMPLATE)), ",").alias("variables"))


@query("chk24_paragraphs", "SELECT doc_id, k, md5(trim(p, chr(10))) AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10)||chr(10))) AS p, unnest(range(0, len(string_split(text, chr(10)||chr(10))))) AS k FROM documents)")
def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.paragraphs(F.col("text"))).alias("k", "p")).select("doc_id", F.col("k").cast("long").alias("k"), F.md5("p").alias("m"))


@query("chk10_24_sentence_counts", "SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?\\x{061F}\\x{061B}\\x{060C}\\x{3002}\\x{FF01}\\x{FF1F}])\\s+', '\\1'||chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS sentences FROM documents")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(S.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("hyb17_advanced_pipeline", f"""WITH {_NEAR}, w AS (SELECT doc_id, n_chars, list_distinct({_W.format('lower(text)')}) AS ws FROM documents),
 t AS (SELECT doc_id, unnest(ws) AS term FROM w), n AS (SELECT q.doc_id AS query_id, b.doc_id AS id, count(*) AS n FROM t q JOIN t b USING (term) WHERE q.doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) GROUP BY 1,2),
 l AS (SELECT query_id, id, n FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) <= 20),
 u AS (SELECT query_id, id, s FROM r WHERE k <= 20 UNION ALL SELECT query_id, id, n/greatest(1,len(ws)) FROM l JOIN w ON w.doc_id=query_id), m AS (SELECT query_id, id, max(s) AS s FROM u GROUP BY 1,2),
 x AS (SELECT query_id, id, round(0.75*s+0.25*CASE WHEN n_chars BETWEEN 500 AND 2000 THEN 1 ELSE 0.5 END,6) AS score FROM m JOIN w ON w.doc_id=id)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""")
def advanced(spark, d):
    """Semantic and lexical candidates, twice as many as needed; each once with its better score; reranked by length."""
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    queries = e.filter("vec_id % 50 = 0")
    semantic = V.batch_topk(e, queries, "vec_id", "embedding", 20).select("query_id", "id", "score")
    own = docs.join(queries.select(F.col("vec_id").alias("doc_id")), "doc_id")
    size = own.select(F.col("doc_id").alias("query_id"), F.greatest(F.lit(1), F.size(F.array_distinct(A.word_list(F.lower("text"))))).alias("words"))
    lexical = R.keyword_search(docs, own, "doc_id", "doc_id", "text", 20).join(size, "query_id").select("query_id", "id", (F.col("n") / F.col("words")).alias("score"))
    once = semantic.unionByName(lexical).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    fit = F.when(F.col("n_chars").between(500, 2000), 1.0).otherwise(0.5)
    scored = once.join(docs.select(F.col("doc_id").alias("id"), "n_chars"), "id").select("query_id", "id", F.round(0.75 * F.col("score") + 0.25 * fit, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("rank <= 5").drop("rank")


@query("sco10_udf02_custom_score", "SELECT doc_id, round(0.6*least(n_chars/2000.0,1)+0.4*CASE lang WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.5 ELSE 0.0 END,6) AS score FROM documents")
def custom(spark, d):
    """A caller's own scoring function takes the columns by name and gives a Column."""
    own = lambda c: 0.6 * F.least(c["n_chars"] / 2000.0, F.lit(1.0)) + 0.4 * F.when(c["lang"] == "en", 1.0).when(c["lang"] == "de", 0.5).otherwise(0.0)
    return A.scored_by(table(spark, d, "documents"), own).select("doc_id", F.round("score", 6).alias("score"))
