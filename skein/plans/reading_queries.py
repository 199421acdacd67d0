"""Texts read from Markdown, pages, SQLite files and sheets, and their languages."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from skein.functions import language as LG
from skein.operators.store import settled, shared_folder
from skein.operators.versions import files_of
from skein.plans.registry import query, table
from skein.sources import markdown as M
from skein.sources import pages as PG
from skein.sources import snapshots as SN

#: Markdown of an order: a heading, a nested quote, lists, a table, fenced and inline code, links, images and escapes.
MARKED = [
    "# Order **{o}** of [customer {c}](http://x.org/c/{c} \"t\")", "", "> Status is *{s}* now", "> > and `{s}*` inside", "", "- first __item__ {o}", "    1. nested ~ {c}", "    2. <b>bold</b> tag", "+ [x] second ![alt](i.png)", "",
    "| key | value |", "|:---|---:|", "| order | {o} |", "| a \\| b | `{c}` |", "", "Sub *heading*", "=====", "```sql", "select **{o}** | x", "  ~~~", "```", "Escaped \\*not {c}\\* & &lt;tag&gt; snake_case_{o}", "***", "[ref]: http://y.org", "see [ref][ref] or <http://z.org/{o}>",
]
#: What a reader of it sees.
SEEN = [
    "Order", "{o}", "of", "customer {c}", "Status is", "{s}", "now", "and", "{s}*", "inside", "first", "item", "{o}", "nested ~ {c}", "bold", "tag", "[x] second", "key", "value", "order", "{o}", "a | b", "{c}", "Sub", "heading",
    "select **{o}** | x", "~~~", "Escaped *not {c}* & <tag> snake_case_{o}", "see", "ref", "or", "http://z.org/{o}",
]


def _sql(lines: list[str]) -> str:
    whole = "\n".join(lines).replace("'", "''")
    for name, column in (("{o}", "o_orderkey"), ("{c}", "o_custkey"), ("{s}", "o_orderstatus")):
        whole = whole.replace(name, f"' || {column} || '")
    return "'" + whole + "'"


@query("src17_markdown_text", f"SELECT o_orderkey, {_sql(SEEN)} AS text FROM orders")
def markdown_text(spark, d):
    """Orders written as Markdown, and read."""
    # Few bytes of a file make long texts, so the rows are dealt out first.
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    docs = orders.select("o_orderkey", F.expr(_sql(MARKED).replace("\\", "\\\\")).alias("text"))
    return M.to_text(docs, ["o_orderkey"], "text")


@query("src17_markdown_documents", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(replace(replace(replace(text, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS text FROM documents WHERE NOT regexp_matches(text, '[*_`#|<>\\[\\]&+~\\\\=]|(?m)^\\s*(-|\\d)')")
def markdown_documents(spark, d):
    """Documents without any mark: every line as it is, trimmed."""
    docs = table(spark, d, "documents").filter(~F.col("text").rlike(r"[*_`#|<>\[\]&+~\\=]|(?m)^\s*(-|\d)"))
    return M.to_text(docs, ["doc_id"], "text").withColumn("text", F.md5("text"))


@query("fun02_language_vote")
def language_vote(spark, d):
    """Every document's language by vote, by profiles of labelled ones; whether it was among these."""
    docs = table(spark, d, "documents")
    profiles = LG.fitted(docs, "doc_id", "text", "lang")
    return LG.voted(docs, "text", profiles).select("doc_id", "lang", "language", LG.sampled("doc_id", LG.SAMPLE, docs.count()).alias("fitted_on"))


_BARE = "html"
for _tag in PG.DROPPED:
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}>', '', 'g')"
_MAIN = "CASE " + " ".join(f"WHEN regexp_matches(h, '(?is)<{t}\\b[^>]*>') THEN regexp_extract(h, '(?is)<{t}\\b[^>]*>(.*?)(</{t}>|$)', 1)" for t in ("main", "article", "section")) + " ELSE h END"
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@query("src05_13_main_text", f"""
WITH b AS (SELECT page_id, {_BARE} AS h FROM pages WHERE NOT regexp_matches(html, '(?i)<div[^>]*class="[^"]*content')), m AS (SELECT page_id, {_MAIN} AS h FROM b), t AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(1), 'g') AS h FROM m),
 u AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM t),
 r AS (SELECT page_id, array_to_string(list_filter(list_transform(string_split(h, chr(1)), lambda x: trim(x, {_BLANKS})), lambda x: x <> ''), chr(10)) AS h FROM u)
SELECT page_id, md5(regexp_replace(array_to_string(list_transform(string_split(h, chr(10)), lambda x: trim(x, {_BLANKS})), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM r""")
def main_texts(spark, d):
    """Main texts of pages whose main part is an element of its own."""
    pages = table(spark, d, "pages").filter(~F.col("html").rlike('(?i)<div[^>]*class="[^"]*content'))
    return PG.extracted(pages, "page_id", "html").withColumn("text", F.md5("text"))


@query("src31_sqlite_snapshots", "SELECT role, count(*) AS turns, sum(length(text)) AS chars, max(turn) AS last FROM conversations GROUP BY 1")
def sqlite_snapshots(spark, d):
    """Conversations written as SQLite files, one a task, and read again by format."""
    SN.register(spark)
    folder = f"{shared_folder(spark)}/sqlite-{uuid.uuid4().hex}"
    table(spark, d, "conversations").repartition(3).write.format("sqlite").option("path", folder).mode("append").save()
    held = spark.read.format("sqlite").option("path", folder).load()
    return held.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last"))


@query("src18_sheets", "SELECT o_orderkey // 500 AS book, CAST(o_orderkey // 100 AS VARCHAR) AS sheet, count(*) AS n, sum(o_custkey) AS customers, round(sum(o_totalprice), 2) AS total, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1, 2")
def sheets(spark, d):
    """Orders written as workbooks, a sheet a hundred, and read again by format."""
    SN.register(spark)
    folder = f"{shared_folder(spark)}/sheets-{uuid.uuid4().hex}"

    def write(key, rows):
        held: dict[str, list[list]] = {}
        for r in sorted(rows.to_pylist(), key=lambda r: r["o_orderkey"]):
            held.setdefault(str(r["o_orderkey"] // 100), [["key", "customer", None, "status", "total"]]).append([r["o_orderkey"], r["o_custkey"], None, r["o_orderstatus"], r["o_totalprice"]])
        files, place = files_of(folder)
        files.create_dir(place, recursive=True)
        with files.open_output_stream(f"{place}/book-{key[0].as_py()}.xlsx") as out:
            out.write(SN.workbook(held))
        return pa.table({"book": pa.array([key[0].as_py()], pa.int64()), "sheets": pa.array([len(held)], pa.int64())})

    books = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 500).alias("book"), "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").groupBy("book").applyInArrow(write, "book long, sheets long")
    settled(books)
    cell = lambda k: F.get("cells", F.lit(k))
    rows = spark.read.format("sheets").option("path", folder).load().filter("row > 1")
    held = rows.select(F.regexp_extract("file", r"book-(\d+)\.xlsx$", 1).cast("long").alias("book"), "sheet", "row", cell(1).cast("long").alias("customer"), cell(3).alias("status"), cell(4).cast("double").alias("total"))
    return held.groupBy("book", "sheet").agg(F.count(F.lit(1)).alias("n"), F.sum("customer").alias("customers"), F.round(F.sum("total"), 2).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "status"))), lambda x: x["status"]), "").alias("statuses"))
