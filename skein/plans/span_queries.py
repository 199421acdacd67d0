"""Chunks with offsets, protected places and pages over texts made of the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import spans as S
from skein.plans.registry import query, table

SIZE, OVERLAP = 40, 8

#: A report of each customer's orders: headings, sentences, lines with tabs, a fenced block and a table mark.
REPORTS = """
o AS (SELECT o_custkey, o_orderkey, '## Order ' || o_orderkey || chr(10) || 'Placed with priority ' || o_orderpriority || '. Status is ' || o_orderstatus || '. Total was ' || CAST(floor(o_totalprice) AS BIGINT) || '.' || chr(10)
  || coalesce(string_agg(l_linenumber || chr(9) || l_partkey || chr(9) || l_suppkey || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey), '') || '[Table] Lines of order ' || o_orderkey || ' end here.' || chr(10)
  || '```' || chr(10) || 'codes ' || coalesce(string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey), '') || chr(10) || '```' || chr(10) AS part
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderpriority, o_orderstatus, o_totalprice),
docs AS (SELECT o_custkey AS id, '# Customer ' || o_custkey || chr(10) || string_agg(part, '' ORDER BY o_orderkey) AS text FROM o GROUP BY 1)"""


#: Orders whose reports one task reads: lines and sentences are many times their rows, and all of a text's pass its task.
ORDERS = 25_000


def _parts(spark, d) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, d, "orders").count() // ORDERS))


def reports(spark, d) -> DataFrame:
    """(id, text), dealt out by id: what follows by id needs no shuffle and stays in tasks of bounded size."""
    lines = F.array_sort(F.collect_list(F.when(F.col("l_linenumber").isNotNull(), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")))).alias("ls")
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice").agg(lines)
    rows = F.array_join(F.transform("ls", lambda x: F.concat_ws("\t", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"), F.concat(x["l_suppkey"].cast("string"), F.lit("\n")))), "")
    codes = F.array_join(F.transform("ls", lambda x: F.concat(x["l_returnflag"], x["l_linestatus"])), " ")
    part = F.concat(
        F.lit("## Order "), F.col("o_orderkey").cast("string"), F.lit("\nPlaced with priority "), "o_orderpriority", F.lit(". Status is "), "o_orderstatus", F.lit(". Total was "), F.floor("o_totalprice").cast("string"), F.lit(".\n"),
        rows, F.lit("[Table] Lines of order "), F.col("o_orderkey").cast("string"), F.lit(" end here.\n```\ncodes "), codes, F.lit("\n```\n"),
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "part"))), lambda x: x["part"])
    dealt = o.withColumn("part", part).select("o_custkey", "o_orderkey", "part").repartition(_parts(spark, d), "o_custkey")
    whole = dealt.groupBy(F.col("o_custkey").alias("id")).agg(parts.alias("parts"))
    return whole.select("id", F.concat(F.lit("# Customer "), F.col("id").cast("string"), F.lit("\n"), F.array_join("parts", "")).alias("text"))


#: Lines with their places, the protected ones of them, fenced blocks by counting their marks, and their union.
_SPANS = """
ln AS (SELECT id, i, x, sum(length(x) + 1) OVER (PARTITION BY id ORDER BY i) AS after FROM (SELECT id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS x FROM (SELECT id, string_split(text, chr(10)) AS ls FROM docs))),
lp AS (SELECT *, after - length(x) - 1 AS a, after - 1 AS b, count(*) FILTER (x = '```') OVER (PARTITION BY id ORDER BY i) AS marks FROM ln),
sp AS (SELECT id, a, b FROM lp WHERE contains(x, chr(9)) OR regexp_matches(x, '^#{1,6} ') OR starts_with(x, '[Table]') UNION ALL SELECT id, min(a), max(b) FROM lp WHERE marks % 2 = 1 OR x = '```' GROUP BY id, (marks + 1) // 2),
sn AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM sp),
su AS (SELECT id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY a, b) AS g FROM sn) GROUP BY id, g)"""

_WORD = "[ \\t\\n\\r]*[^ \\t\\n\\r]+"


def _windows(size: int, overlap: int) -> str:
    """Windows of words, from the places of all words."""
    step = size - overlap
    return f"""
wp AS (SELECT id, length(text) AS total, i, sum(length(x)) OVER (PARTITION BY id ORDER BY i) AS b, sum(length(x)) OVER (PARTITION BY id ORDER BY i) - length(x) AS a, count(*) OVER (PARTITION BY id) AS n
  FROM (SELECT id, text, unnest(generate_series(0, len(ws) - 1)) AS i, unnest(ws) AS x FROM (SELECT id, text, regexp_extract_all(text, '{_WORD}') AS ws FROM docs))),
win AS (SELECT f.id, f.i // {step} AS chunk, f.a, CASE WHEN f.i + {size} >= f.n THEN f.total ELSE l.b END AS b FROM wp f LEFT JOIN wp l ON l.id = f.id AND l.i = f.i + {size - 1} WHERE f.i % {step} = 0 AND (f.i = 0 OR f.i - {step} + {size} < f.n))"""


_MOVED = f"""
m1 AS (SELECT w.id, w.chunk, coalesce(s.a, w.a) AS a, w.b FROM win w LEFT JOIN su s ON s.id = w.id AND s.a < w.a AND w.a < s.b),
m2 AS (SELECT DISTINCT m.id, m.a, CASE WHEN s.a IS NULL THEN m.b WHEN s.a > m.a + {S.LEAST} THEN s.a ELSE s.b END AS b FROM m1 m LEFT JOIN su s ON s.id = m.id AND s.a < m.b AND m.b < s.b),
kept AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS chunk FROM (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM m2) WHERE far IS NULL OR b > far)"""


@query("chk04_protected_spans", f"WITH {REPORTS}, {_SPANS} SELECT id, a AS start, b AS stop FROM su")
def protected_spans(spark, d):
    docs = reports(spark, d)
    return S.union(S.protected(docs, ["id"], "text"), ["id"])


@query("chk04_12_protected_chunks", f"WITH {REPORTS}, {_SPANS}, {_windows(SIZE, OVERLAP)}, {_MOVED} SELECT k.id, k.chunk, k.a AS start, k.b AS stop, md5(substring(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))) AS content FROM kept k JOIN docs USING (id)")
def protected_chunks(spark, d):
    return S.protected_chunks(reports(spark, d), ["id"], "text", SIZE, OVERLAP).withColumn("content", F.md5("content"))


@query("chk01_windows_with_offsets", f"WITH docs AS (SELECT doc_id AS id, text FROM documents), {_windows(358, 50)} SELECT id AS doc_id, chunk, a AS start, b AS stop FROM win")
def windows_with_offsets(spark, d):
    return S.token_windows(table(spark, d, "documents"), ["doc_id"], "text", 358, 50)


#: Sentences by marking what separates them: the first pattern that marks anything.
_SENTENCES = """
mk AS (SELECT id, text, CASE WHEN p1 <> text THEN p1 WHEN p2 <> text THEN p2 WHEN p3 <> text THEN p3 ELSE p4 END AS marked FROM (SELECT id, text,
  regexp_replace(text, '([.!?])(\\s+)([A-Z])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g') AS p1, regexp_replace(text, '([。！？])(\\s*)', '\\1' || chr(1) || '\\2' || chr(2), 'g') AS p2,
  regexp_replace(text, '([.!?])(\\s+)(\\S)', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g') AS p3, regexp_replace(text, '([\\x{061F}\\x{061B}\\x{060C}])(\\s+)', '\\1' || chr(1) || '\\2' || chr(2), 'g') AS p4 FROM docs)),
pt AS (SELECT id, unnest(generate_series(0, len(ps) - 1)) AS i, unnest(ps) AS p FROM (SELECT id, string_split(marked, chr(1)) AS ps FROM mk)),
pl AS (SELECT id, i, CASE WHEN i = 0 THEN p ELSE split_part(p, chr(2), 2) END AS s, length(replace(p, chr(2), '')) AS n FROM pt),
st AS (SELECT id, i, s, sum(n) OVER (PARTITION BY id ORDER BY i) AS b FROM pl),
se AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS sentence, b - length(s) AS start, b AS stop, s FROM st WHERE length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) >= 8)"""


@query("chk10_sentence_offsets", f"WITH docs AS (SELECT doc_id AS id, text FROM documents), {_SENTENCES} SELECT id AS doc_id, sentence, start, stop FROM se")
def sentence_offsets(spark, d):
    return S.sentences(table(spark, d, "documents"), ["doc_id"], "text")


#: Sentences by fives, cut where a protected place begins or ends between two of them.
GROUP, SMALL, LARGE = 5, 12, 30


def structured(spark, d) -> DataFrame:
    docs = reports(spark, d)
    members = S.sentences(docs, ["id"], "text").withColumn("group", F.floor(F.col("sentence") / GROUP))
    parts = S.split_at_spans(members, S.union(S.protected(docs, ["id"], "text"), ["id"]), ["id"], "group", "sentence")
    return parts.groupBy("id", "group", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("sentence").alias("first"), F.max("sentence").alias("last"))


_STRUCTURED = f"""WITH {REPORTS}, {_SPANS}, {_SENTENCES},
 ed AS (SELECT id, a AS edge FROM su UNION SELECT id, b FROM su),
 me AS (SELECT *, sentence // {GROUP} AS "group", lag(stop) OVER (PARTITION BY id, sentence // {GROUP} ORDER BY sentence) AS before FROM se),
 cu AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM ed WHERE ed.id = me.id AND edge BETWEEN before AND start) THEN 1 ELSE 0 END AS cut FROM me),
 pa AS (SELECT *, sum(cut) OVER (PARTITION BY id, "group" ORDER BY sentence) AS part FROM cu)"""


@query("chk12_structural_groups", f'{_STRUCTURED} SELECT id, "group", part, min(start) AS start, max(stop) AS stop, min(sentence) AS first, max(sentence) AS last FROM pa GROUP BY id, "group", part')
def structural_groups(spark, d):
    return structured(spark, d)


@query("chk13_14_sized_chunks", f"""{_STRUCTURED},
 ch AS (SELECT id, min(start) AS start, max(stop) AS stop, string_agg(trim(s, chr(32)||chr(9)||chr(10)), ' ' ORDER BY sentence) AS content, row_number() OVER (PARTITION BY id ORDER BY "group", part) AS k FROM pa GROUP BY id, "group", part),
 cn AS (SELECT *, len(regexp_extract_all(content, '\\S+')) AS n FROM ch),
 ho AS (SELECT *, sum(CASE WHEN n >= {SMALL // 2} OR k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS home FROM cn),
 hm AS (SELECT id, home, min(start) AS start, max(stop) AS stop, arg_min(content, k) AS base, arg_min(n, k) AS n, string_agg(content, ' ' ORDER BY k) FILTER (k > first_k) AS tail FROM (SELECT *, min(k) OVER (PARTITION BY id, home) AS first_k FROM ho) GROUP BY id, home),
 pc AS (SELECT *, unnest(generate_series(0, CASE WHEN n <= {LARGE} THEN 0 ELSE CAST(ceil((n - {LARGE}) / {LARGE}) AS BIGINT) END)) AS piece FROM hm),
 wh AS (SELECT *, CASE WHEN n <= {LARGE} THEN base ELSE array_to_string(regexp_extract_all(base, '\\S+')[piece * {LARGE} + 1 : piece * {LARGE} + {LARGE}], ' ') END AS own, piece = max(piece) OVER (PARTITION BY id, home) AS last FROM pc),
 fi AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY home, piece) - 1 AS chunk, start, stop, CASE WHEN last AND tail IS NOT NULL THEN own || ' ' || tail ELSE own END AS content FROM wh)
SELECT id, chunk, start, stop, len(regexp_extract_all(content, '\\S+')) AS tokens, md5(content) AS content FROM fi""")
def sized_chunks(spark, d):
    """Groups of sentences as chunks, each sentence trimmed, within bounds of size."""
    docs = reports(spark, d)
    members = S.sentences(docs, ["id"], "text").withColumn("group", F.floor(F.col("sentence") / GROUP))
    parts = S.split_at_spans(members, S.union(S.protected(docs, ["id"], "text"), ["id"]), ["id"], "group", "sentence")
    said = S.contents(parts, docs, ["id"], "text").withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", ""))
    chunks = said.groupBy("id", "group", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "content"))), lambda x: x["content"]), " ").alias("content"))
    return S.sized(chunks, ["id"], ["group", "part"], SMALL, LARGE).withColumn("content", F.md5("content"))


#: Lines of a page.
PAGE = 5


@query("chk09_pages_of_chunks", f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {_windows(358, 50)},
 ln AS (SELECT id, i, sum(length(x) + 1) OVER (PARTITION BY id ORDER BY i) AS b, length(x) + 1 AS n FROM (SELECT id, unnest(generate_series(0, len(ls) - 1)) AS i, unnest(ls) AS x FROM (SELECT id, string_split(text, chr(10)) AS ls FROM docs))),
 pg AS (SELECT id, i // {PAGE} + 1 AS page, min(b - n) AS a, max(b) AS b FROM ln GROUP BY 1, 2)
SELECT win.id AS doc_id, chunk, win.a AS start, win.b AS stop, min(page) AS first_page, max(page) AS last_page FROM win JOIN pg ON pg.id = win.id AND pg.a < win.b AND pg.b > win.a GROUP BY 1, 2, 3, 4""")
def pages_of_chunks(spark, d):
    docs = table(spark, d, "documents")
    return S.paged(S.token_windows(docs, ["doc_id"], "text", 358, 50), S.pages_of(docs, ["doc_id"], "text", PAGE), ["doc_id"])
