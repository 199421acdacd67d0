"""Vector, keyword and hybrid search, scoring and text functions over the standard tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import scoring as S
from skein.functions import text as X
from skein.operators import retrieval as R
from skein.operators import vectors as V
from skein.operators.store import settled
from skein.plans.registry import query, table

_COS = "CASE WHEN list_inner_product(a,a)=0 OR list_inner_product(b,b)=0 THEN 0 ELSE list_inner_product(a,b)/(sqrt(list_inner_product(a,a))*sqrt(list_inner_product(b,b))) END"
_PAIRS = "p AS (SELECT q.vec_id qid, r.vec_id id, r.label lab, q.label qlab, q.embedding::DOUBLE[] a, r.embedding::DOUBLE[] b FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0)"
_TOP = f"WITH {_PAIRS}, s AS (SELECT qid, id, lab, qlab, round({_COS},9) score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) rank FROM s)"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


def _asked(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.filter("vec_id % 50 = 0")


@query("vec01_03_similarities", """
WITH z AS (SELECT embedding::DOUBLE[] q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], q),6) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], q),6) AS cosine, round(0.0-list_distance(embedding::DOUBLE[], q),6) AS l2,
 round(embedding[1]::DOUBLE/sqrt(list_inner_product(embedding::DOUBLE[],embedding::DOUBLE[])),6) AS unit0 FROM embeddings, z""")
def similarities(spark, d):
    e = table(spark, d, "embeddings")
    t = e.join(F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").alias("q"))))
    v, q = F.col("embedding"), F.col("q")
    return t.select("vec_id", F.round(V.dot(v, q), 6).alias("dot"), F.round(V.cosine(v, q), 6).alias("cosine"), F.round(V.negative_l2(v, q) + 0.0, 6).alias("l2"), F.round(V.normalised(v)[0], 6).alias("unit0"))


@query("vec04_12_batch_topk", f"{_TOP} SELECT qid AS query_id, id, rank, round(score,6) AS score FROM r WHERE rank <= 10")
def batch(spark, d):
    e, asked = _asked(spark, d)
    return V.batch_topk(e, asked, "vec_id", "embedding", 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("vec07_postfilter", f"{_TOP} SELECT qid AS query_id, id FROM r WHERE rank <= 10 AND lab = qlab")
def postfilter(spark, d):
    e, asked = _asked(spark, d)
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("lab"))
    top = V.batch_topk(e, asked, "vec_id", "embedding", 10)
    return top.join(labels, "id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlab")), "query_id").filter("lab = qlab").select("query_id", "id")


@query("vec08_prefilter", f"WITH {_PAIRS}, s AS (SELECT qid, id, round({_COS},9) score FROM p WHERE lab < 5), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) rank FROM s) SELECT qid AS query_id, id FROM r WHERE rank <= 10")
def prefilter(spark, d):
    e, asked = _asked(spark, d)
    return V.batch_topk(e.filter("label < 5"), asked, "vec_id", "embedding", 10).select("query_id", "id")


@query("vec10_overfetch", f"{_TOP} SELECT qid AS query_id, id, round(1-(1-score),6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) k FROM r WHERE rank <= 20 AND score >= 0.3) WHERE k <= 10")
def overfetch(spark, d):
    e, asked = _asked(spark, d)
    top = V.batch_topk(e, asked, "vec_id", "embedding", 20).filter("score >= 0.3 and rank <= 10")
    return top.select("query_id", "id", F.round("score", 6).alias("score"))


@query("vec13_hash_embedding", """
WITH t AS (SELECT item_id, md5(text || '_' || CAST(item_id AS VARCHAR)) m FROM benchmark) SELECT item_id, """ + ", ".join(f"round(CAST(('0x'||substr(m,{8 * i + 1},8)) AS UBIGINT)/4294967295.0*2-1,9) AS e{i}" for i in range(4)) + ", 768 AS dim FROM t")
def hashed(spark, d):
    t = table(spark, d, "benchmark").select("item_id", V.hash_embedding(F.col("text"), F.col("item_id")).alias("e"))
    return t.select("item_id", *[F.round(F.col("e")[i], 9).alias(f"e{i}") for i in range(4)], F.size("e").alias("dim"))


@query("vec15_collapse", "SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS m FROM documents")
def collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.collapse(F.col("text"))).alias("m"))


@query("vec17_parent_boost", "WITH q AS (SELECT embedding AS v FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, label, round((1+list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]))/2,9) AS s FROM embeddings, q) SELECT vec_id, round(least(1.0, s + 0.1*max(s) OVER (PARTITION BY label)),6) AS score FROM s")
def boost(spark, d):
    """Likeness to the first vector, raised by the best of a vector's label."""
    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("_v"))
    scored = e.crossJoin(first).select("vec_id", "label", F.round((1 + V.cosine(F.col("embedding"), F.col("_v"))) / 2, 9).alias("score"))
    return V.parent_boost(scored, "score", "label").select("vec_id", F.round("score", 6).alias("score"))


@query("fun20_retrieval_metrics", f"""{_TOP}, k AS (SELECT qid, rank, CAST(lab=qlab AS INT) rel FROM r WHERE rank <= 10), t AS (SELECT q.vec_id qid, count(*) n FROM embeddings q JOIN embeddings e ON q.label=e.label WHERE q.vec_id % 50 = 0 GROUP BY 1)
SELECT k.qid AS query_id, round(sum(rel)/max(n),6) AS recall, round(coalesce(max(rel/rank),0),6) AS mrr, round(sum(rel/log2(rank+1))/max(list_sum(list_transform(generate_series(1, least(n,10)), lambda i: 1/log2(i+1)))),6) AS ndcg FROM k JOIN t USING (qid) GROUP BY 1""")
def metrics(spark, d):
    e, asked = _asked(spark, d)
    lab = e.select(F.col("vec_id").alias("id"), F.col("label").alias("lab"))
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlab"))
    n = e.groupBy(F.col("label").alias("qlab")).agg(F.count(F.lit(1)).alias("n"))
    t = V.batch_topk(e, asked, "vec_id", "embedding", 10).join(lab, "id").join(q.join(n, "qlab"), "query_id").withColumn("rel", (F.col("lab") == F.col("qlab")).cast("int"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.max("n"), F.lit(10))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return t.groupBy("query_id").agg(F.round(F.sum("rel") / F.max("n"), 6).alias("recall"), F.round(F.max(F.col("rel") / F.col("rank")), 6).alias("mrr"), F.round(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)) / ideal, 6).alias("ndcg"))


_KW = f"""WITH dt AS (SELECT DISTINCT doc_id id, unnest({_WORDS.format('lower(text)')}) term FROM documents), qt AS (SELECT DISTINCT item_id qid, unnest({_WORDS.format('lower(text)')}) term FROM benchmark),
 n AS (SELECT qid, id, count(*) n FROM dt JOIN qt USING (term) GROUP BY 1,2), kw AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, id) rank FROM n)"""


@query("hyb04_05_keyword_search", f"{_KW} SELECT qid AS query_id, id, n, rank FROM kw WHERE rank <= 10")
def keyword(spark, d):
    return R.keyword_search(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id", "text", 10)


@query("hyb07_09_rank_fusion", f"""{_KW}, a AS (SELECT qid, id, 1-(rank-1)/count(*) OVER (PARTITION BY qid) v FROM kw WHERE rank <= 20), s AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY n DESC, id DESC) rank FROM n),
 b AS (SELECT qid, id, 1-(rank-1)/count(*) OVER (PARTITION BY qid) v FROM s WHERE rank <= 20), f AS (SELECT coalesce(a.qid,b.qid) qid, coalesce(a.id,b.id) id, coalesce(b.v,0) sem, coalesce(a.v,0) kw FROM a FULL JOIN b ON a.qid=b.qid AND a.id=b.id)
SELECT qid AS query_id, id, round(sem,4) AS semantic, round(kw,4) AS keyword, round(0.7*sem+0.3*kw,6) AS score FROM f WHERE 0.7*sem+0.3*kw >= 0.3""")
def fusion(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = settled(R.keyword_candidates(docs, asked, "doc_id", "item_id", "text", 20, (False, True)))
    kw, sem = R.placed(n, [F.desc("n"), "id"], 20), R.placed(n, [F.desc("n"), F.desc("id")], 20)
    f = R.fuse(sem, kw, 0.7, ["query_id", "id"]).filter("score >= 0.3")
    return f.select("query_id", "id", F.round("semantic", 4).alias("semantic"), F.round("keyword", 4).alias("keyword"), F.round("score", 6).alias("score"))


@query("hyb08_adaptive_alpha", f"SELECT item_id, round(greatest(0.0, least(1.0, CASE WHEN len({_WORDS.format('text')}) <= 3 THEN 0.5 WHEN len({_WORDS.format('text')}) >= 15 THEN 0.8 ELSE 0.7 END)),4) AS alpha FROM benchmark")
def alpha(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(S.adaptive_alpha(F.size(X.words(F.col("text")))), 4).alias("alpha"))


@query("rrk02_hyb12_13_rerank", f"""{_KW}, c AS (SELECT qid, kw.id, list_distinct({_WORDS.format('lower(q.text)')}) a, list_distinct({_WORDS.format('lower(t.text)')}) b FROM kw JOIN benchmark q ON qid=item_id JOIN documents t ON kw.id=doc_id WHERE rank <= 20),
 p AS (SELECT qid, id, len(list_intersect(a,b)) i, len(a) n, len(list_distinct(list_concat(a,b))) u FROM c) SELECT qid AS item_id, id AS doc_id, round(i/u,6) AS jaccard, round(0.8*0.5+0.2*i/n,6) AS simple, round(0.7*0.5+0.3*i/n,6) AS retriever FROM p WHERE i/u >= 0.1""")
def rerank(spark, d):
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    found = R.keyword_search(docs, asked, "doc_id", "item_id", "text", 20)
    p = found.join(asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("q")), "query_id").join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t")), "id")
    p = p.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), X.jaccard(F.col("q"), F.col("t")).alias("j"), X.overlap(F.col("q"), F.col("t")).alias("o"))
    return p.filter("j >= 0.1").select("item_id", "doc_id", F.round("j", 6).alias("jaccard"), F.round(0.4 + 0.2 * F.col("o"), 6).alias("simple"), F.round(0.35 + 0.3 * F.col("o"), 6).alias("retriever"))


@query("hyb16_dedup_prefix", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY substr(text,1,100) ORDER BY doc_id) r FROM documents) WHERE r = 1")
def dedup(spark, d):
    return R.first_seen(table(spark, d, "documents"), ["doc_id"], F.substring("text", 1, 100)).select("doc_id")


@query("prj05_truncate", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN 4003 ELSE length(text) END AS n, md5(CASE WHEN length(text) > 4000 THEN substr(text,1,4000)||'...' ELSE text END) AS m FROM documents")
def truncate(spark, d):
    t = X.truncated(F.col("text"), 4000)
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("n"), F.md5(t).alias("m"))


@query("prj07_context_budget", f"""WITH t AS (SELECT source, doc_id, len({_WORDS.format('text')}) n FROM documents), r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) u FROM t)
SELECT source, doc_id, CASE WHEN u <= 3000 THEN n ELSE 3000-(u-n) END AS kept FROM r WHERE u <= 3000 OR 3000-(u-n) > 10""")
def budget(spark, d):
    t = table(spark, d, "documents").select("source", "doc_id", F.size(X.words(F.col("text"))).alias("n"))
    b = R.within_budget(t, ["source"], ["doc_id"], "n", 3000)
    return b.filter("n <= left or left > 10").select("source", "doc_id", F.least("n", "left").alias("kept"))


@query("prj10_11_citations", "SELECT lang, round(least(1.0, count(*)/500.0),6) AS confidence, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY 1")
def citations(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.least(F.lit(1.0), F.count(F.lit(1)) / 500.0), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


_O = "SELECT o_orderkey, o_totalprice/600000.0 base, coalesce(n,0) n, v, coalesce(l,0) l, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') d, (CAST(coalesce(o_orderstatus<>'',false) AS INT)+CAST(coalesce(o_orderpriority<>'',false) AS INT))/2.0 m FROM orders JOIN (SELECT o_custkey, count(*) * 100 AS v FROM orders GROUP BY 1) USING (o_custkey) LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) * 20 AS BIGINT) AS n, count(*) * 100 AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


@query("sco01_09_scores", f"""WITH o AS ({_O}), s AS (SELECT o_orderkey, base, CASE WHEN n<500 THEN n/500 WHEN n<=2000 THEN 1.0 ELSE greatest(0.5,1-(n-2000)/10000) END len, CASE WHEN d<=7 THEN 1.0 WHEN d<=30 THEN 0.8 WHEN d<=90 THEN 0.6 WHEN d<=365 THEN 0.4 ELSE 0.2 END rec, m, base*exp(-0.1*d) dec,
 greatest(0,least(1,0.7*base+0.3*(least(v/1000,1)*0.3+least(l/1000,1)*0.4))) pop FROM o), w AS (SELECT *, greatest(0,least(1,0.5*base+0.1*len+0.1*m+0.2*rec)) wt FROM s)
SELECT o_orderkey, round(len,9) AS length, rec AS recency, round(wt,9) AS weighted, round(dec,9) AS decay, round(pop,9) AS popularity, round(0.4*wt+0.2*dec+0.2*pop+0.2*m,9) AS hybrid FROM w""")
def scores(spark, d):
    """Orders as documents: length by what was ordered, views by the customer's orders, likes by lines, in hundreds."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_quantity") * 20).cast("long").alias("n"), (F.count(F.lit(1)) * 100).alias("l"))
    views = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 100).alias("v"))
    o = table(spark, d, "orders").join(views, "o_custkey").join(lines, "o_orderkey", "left").fillna(0, ["n", "l"])
    days = S.age_days(F.to_date("o_orderdate"), F.lit("1998-08-02").cast("date"))
    base = F.col("o_totalprice") / 600000.0
    t = o.select("o_orderkey", base.alias("base"), S.length_score(F.col("n")).alias("len"), S.recency(days).alias("rec"), S.metadata_quality([F.col("o_orderstatus"), F.col("o_orderpriority")]).alias("m"), S.decayed(base, days).alias("dec"), S.popularity(base, F.col("v"), F.col("l"), F.lit(0), F.lit(0)).alias("pop"))
    t = t.withColumn("wt", S.weighted(F.col("base"), F.col("len"), F.col("m"), F.col("rec")))
    h = S.hybrid(F.col("wt"), F.col("dec"), F.col("pop"), F.col("m"))
    return t.select("o_orderkey", F.round("len", 9).alias("length"), F.col("rec").alias("recency"), F.round("wt", 9).alias("weighted"), F.round("dec", 9).alias("decay"), F.round("pop", 9).alias("popularity"), F.round(h, 9).alias("hybrid"))


@query("src03_text_statistics", """SELECT doc_id, length(text) AS char_count, len(list_filter(string_split_regex(text,'\\s+'), lambda x: x<>'')) AS word_count, len(regexp_extract_all(text,'\\n'))+1 AS line_count, len(regexp_extract_all(text,'\\p{L}')) AS alpha_count, len(regexp_extract_all(text,'[0-9]')) AS digit_count,
 len(regexp_extract_all(text,'\\s')) AS space_count, 0.0 AS persian_ratio, round(len(regexp_extract_all(text,'\\p{L}'))/len(list_filter(string_split_regex(text,'\\s+'), lambda x: x<>'')),6) AS avg_word_length FROM documents""")
def statistics(spark, d):
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in X.statistics(F.col("text"), 6).items()])


@query("fun01_script_language", "SELECT doc_id, CASE WHEN length(regexp_replace(text,'\\s+','','g'))=0 OR len(regexp_extract_all(text,'[a-zA-Z]'))/length(regexp_replace(text,'\\s+','','g'))>0.3 THEN 'en' ELSE 'en' END AS language FROM documents")
def language(spark, d):
    return table(spark, d, "documents").select("doc_id", X.script_language(F.col("text")).alias("language"))


_TOX = "(" + "+".join(f"CAST(contains(lower(text),'{w}') AS INT)" for w in X.TOXIC) + ")"


@query("fun03_06_content", f"""SELECT doc_id, {_TOX} AS toxic_words, round(least({_TOX}/3,1),6) AS toxicity, round(least(1.0,0.3*(len(regexp_extract_all(text,'[0-9]{{4,}}'))+len(regexp_extract_all(text,'[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}'))+len(regexp_extract_all(text,'\\+[1-9][0-9]{{6,14}}')))),6) AS personal,
 md5(regexp_replace(text, '{"|".join(X.TOXIC)}', '[FILTERED]', 'gi')) AS redacted FROM documents""")
def content(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.held(t, X.TOXIC).alias("toxic_words"), F.round(F.least(X.held(t, X.TOXIC) / 3, F.lit(1.0)), 6).alias("toxicity"), F.round(X.personal_score(t), 6).alias("personal"), F.md5(X.redact(t, X.TOXIC)).alias("redacted"))


@query("fun08_11_query_features", f"""WITH t AS (SELECT conv_id, turn, text, len({_WORDS.format('text')}) w FROM conversations WHERE role='user')
SELECT conv_id, turn, round(0.3*least(w/20,1)+0.2*least(length(text)/200,1)+0.2*least(len(regexp_extract_all(text,'\\?'))/3,1)+0.3*least(len(regexp_extract_all(text,'[^A-Za-z0-9_\\s]'))/10,1),6) AS complexity, CASE WHEN w<=3 THEN 'short' WHEN w<=8 THEN 'medium' ELSE 'long' END AS band,
 CASE WHEN regexp_matches(lower(text),'count|sum|average|total') THEN 'aggregation' WHEN regexp_matches(lower(text),'search|find|look') THEN 'search' WHEN regexp_matches(lower(text),'get|retrieve|show') THEN 'retrieval' ELSE 'general' END AS kind FROM t""")
def features(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.round(X.complexity(t), 6).alias("complexity"), X.length_band(t).alias("band"), X.query_type(t).alias("kind"))


@query("fun12_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, substr(sha256(text),1,16) AS short_ FROM documents")
def hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.substring(F.sha2("text", 256), 1, 16).alias("short_"))


@query("fun22_27_answer_quality", f"""WITH q AS (SELECT conv_id, turn, text q FROM conversations WHERE role='user'), a AS (SELECT conv_id, turn-1 turn, text a FROM conversations WHERE role='assistant'),
 p AS (SELECT conv_id, turn, list_distinct({_WORDS.format('lower(q)')}) qs, list_distinct({_WORDS.format('lower(a)')}) s, len({_WORDS.format('a')}) n FROM q JOIN a USING (conv_id, turn))
SELECT conv_id, turn, round(len(list_intersect(qs,s))/len(qs),6) AS relevance, round(least(n/50,1),6) AS completeness FROM p WHERE len(qs) > 0""")
def answers(spark, d):
    c = table(spark, d, "conversations")
    q = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    p = q.join(a, ["conv_id", "turn"]).filter(F.size(X.words(F.col("q"))) > 0)
    return p.select("conv_id", "turn", F.round(X.overlap(F.col("q"), F.col("a")), 6).alias("relevance"), F.round(X.completeness(F.col("a"), 50), 6).alias("completeness"))
