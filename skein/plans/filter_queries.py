"""Predicates over the standard tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from skein.operators import filters as P
from skein.operators import predicates as PT
from skein.operators.filters import Composite, Condition
from skein.plans.registry import query, table


@query("flt01_06_generic", """
SELECT doc_id, lang, n_chars FROM documents
WHERE lang = 'en' AND source <> 'src1' AND n_chars > 500 AND n_chars <= 9000 AND source IN ('src0','src2','src3') AND lang NOT IN ('fr')
  AND contains(CAST(n_chars AS VARCHAR), '1') AND regexp_matches(text, '[Tt]he') AND text IS NOT NULL""")
def generic(spark, d):
    wanted = [Condition("lang", "eq", "en"), Condition("source", "ne", "src1"), Condition("n_chars", "gt", 500), Condition("n_chars", "lte", 9000), Condition("source", "in", ["src0", "src2", "src3"]), Condition("lang", "nin", ["fr"]), Condition("n_chars", "contains", 1), Condition("text", "regex", "the", True), Condition("text", "exists", True)]
    return table(spark, d, "documents").filter(Composite("and", tuple(wanted[:6] + wanted[6:7] + [Condition("text", "regex", "[Tt]he")] + wanted[8:])).column()).select("doc_id", "lang", "n_chars")


@query("flt07_range", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice > 905.5 AND p_retailprice < 920.25")
def ranges(spark, d):
    return table(spark, d, "part").filter(P.in_range(F.col("p_size"), 10, 20) & P.in_range(F.col("p_retailprice"), 905.5, 920.25, inclusive=False)).select("p_partkey", "p_size", "p_retailprice")


@query("flt08_date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def dates(spark, d):
    return table(spark, d, "orders").filter(P.in_dates(F.col("o_orderdate"), "1995-01-01", "1996-12-31")).select("o_orderkey", "o_orderdate")


@query("flt09_text", """
SELECT c_custkey, contains(lower(c_name), 'cust') AS has, starts_with(lower(c_name), 'customer') AS starts, ends_with(lower(c_name), '7') AS ends_, lower(c_mktsegment) = 'building' AS exact_ FROM customer""")
def text(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", P.text_matches(F.col("c_name"), "Cust").alias("has"), P.text_matches(F.col("c_name"), "Customer", "starts").alias("starts"), P.text_matches(F.col("c_name"), "7", "ends").alias("ends_"), P.text_matches(F.col("c_mktsegment"), "Building", "exact").alias("exact_"))


@query("flt10_tolerance", """
SELECT p_partkey, abs(p_retailprice-950.0)<=10.0 AS eq, abs(p_retailprice-950.0)>10.0 AS ne, p_retailprice>960.0 AS gt, p_retailprice>=940.0 AS gte, p_retailprice<940.0 AS lt, p_retailprice<=960.0 AS lte FROM part""")
def tolerance(spark, d):
    return table(spark, d, "part").select("p_partkey", *[P.near(F.col("p_retailprice"), 950.0, op, 10.0).alias(op) for op in ("eq", "ne", "gt", "gte", "lt", "lte")])


@query("flt11_arrays", """
WITH t AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, list_has_any(w, ['the','der']) AS any_, NOT list_has_any(w, ['the','der']) AS none_, list_has_all(w, ['the','of']) AS all_ FROM t""")
def arrays(spark, d):
    w = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    t = table(spark, d, "documents").select("doc_id", w.alias("w"))
    return t.select("doc_id", P.array_matches(F.col("w"), ["the", "der"], "any").alias("any_"), P.array_matches(F.col("w"), ["the", "der"], "none").alias("none_"), P.array_matches(F.col("w"), ["the", "of"], "all").alias("all_"))


@query("flt12_geo", """
WITH t AS (SELECT c_custkey, 30.0 + (c_custkey % 97) * 0.1 AS lat, 50.0 + (c_custkey % 89) * 0.1 AS lon FROM customer),
 k AS (SELECT c_custkey, 2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(lat-35.0)/2),2)+cos(radians(lat))*cos(radians(35.0))*pow(sin(radians(lon-54.0)/2),2)))) AS km FROM t)
SELECT c_custkey, round(km, 4) AS km FROM k WHERE km <= 250.0""")
def geo(spark, d):
    t = table(spark, d, "customer").select("c_custkey", (30.0 + (F.col("c_custkey") % 97) * 0.1).alias("lat"), (50.0 + (F.col("c_custkey") % 89) * 0.1).alias("lon"))
    return t.filter(P.within_km(F.col("lat"), F.col("lon"), 35.0, 54.0, 250.0)).select("c_custkey", F.round(P.distance_km(F.col("lat"), F.col("lon"), 35.0, 54.0), 4).alias("km"))


@query("flt13_14_composite", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND NOT coalesce(o_orderpriority = '1-URGENT', false)")
def composite(spark, d):
    c = Composite("and", (Composite("or", (Condition("o_orderstatus", "eq", "F"), Condition("o_totalprice", "gt", 200000))), Composite("not", (Condition("o_orderpriority", "eq", "1-URGENT"),))))
    return table(spark, d, "orders").filter(c.column()).select("o_orderkey")


@query("flt15_19_document_filters", """
SELECT o_orderkey, (o_totalprice >= 1000 AND o_totalprice < 150000 AND o_orderstatus IN ('O','F')) AS base, (o_totalprice >= 1000 AND o_orderstatus <> 'P') AS store,
 (o_totalprice > 5000 AND o_orderstatus = 'O') AS aggregate_, ((o_totalprice > 5000 AND contains(o_orderpriority, 'H')) OR o_orderstatus = 'F') AS where_, (o_orderstatus = 'O' AND NOT coalesce(o_totalprice < 9000, false)) AS must_ FROM orders""")
def documents(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        P.from_document({"o_totalprice": {"$gte": 1000, "$lt": 150000}, "o_orderstatus": ["O", "F"]}).alias("base"),
        P.from_document({"o_totalprice": {"$gte": 1000, "$gt": 10**9}, "o_orderstatus": {"$ne": "P"}}, "store").alias("store"),
        P.from_document({"o_totalprice": {"$gt": 5000, "$in": [1]}, "o_orderstatus": "O"}, "aggregate").alias("aggregate_"),
        P.from_document({"$or": [{"o_totalprice": {"$gt": 5000}, "o_orderpriority": {"$contains": "H"}}, {"o_orderstatus": "F"}]}, "where").alias("where_"),
        P.must([F.col("o_orderstatus") == "O"], [F.col("o_totalprice") < 9000]).alias("must_"),
    )


@query("flt20_21_thresholds", """
WITH t AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0.0 ELSE value END AS s FROM events)
SELECT event_id, (s IS NULL OR s >= -1) AS kept, coalesce(s <> 0 AND s >= -1, false) AS truthy FROM t""")
def thresholds(spark, d):
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, 0.0).otherwise(F.col("value")).alias("s"))
    return t.select("event_id", P.passes(F.col("s"), -1).alias("kept"), P.passes_if_truthy(F.col("s"), -1).alias("truthy"))


@query("flt22_recent_questions", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND regexp_matches(text, 'recent|latest|new|old|today|yesterday', 'i')")
def recent(spark, d):
    return table(spark, d, "conversations").filter((F.col("role") == "user") & P.asks_for_recent(F.col("text"))).select("conv_id", "turn")


@query("flt23_fields", "SELECT k AS field, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events WHERE props IS NOT NULL) GROUP BY k")
def fields(spark, d):
    keys = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("field"))
    return keys.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query("flt24_25_tenant", """
SELECT doc_id, source FROM documents WHERE source = 'src3' AND length(text) >= 10 AND NOT contains(lower(text), 'idiot') AND NOT contains(lower(text), 'scum')""")
def tenant(spark, d):
    return table(spark, d, "documents").filter((F.col("source") == "src3") & P.tenant_content(F.col("text"), ["idiot", "scum"])).select("doc_id", "source")


#: Loose filters and the SQL of what they mean.
WHERES = [
    ({"c_mktsegment": "BUILDING", "c_nationkey": [1, 2, 3]}, "c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3)"),
    ({"c_acctbal": {"$gte": 100, "$lt": 5000, "$regex": "never read"}}, "c_acctbal >= 100 AND c_acctbal < 5000"),
    ({"c_name": {"$contains": "7"}, "c_mktsegment": {"$nin": ["BUILDING", "MACHINERY"]}}, "contains(c_name, '7') AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ({"c_name": {"$not_contains": "1"}}, "NOT contains(c_name, '1')"),
    ({"$or": [{"c_nationkey": {"$eq": 4}}, {"$and": [{"c_acctbal": {"$lt": 0}}, {"c_mktsegment": {"$ne": "BUILDING"}}]}]}, "c_nationkey = 4 OR (c_acctbal < 0 AND c_mktsegment <> 'BUILDING')"),
    ({"c_name": {"$like": "unknown"}}, "true"),
]


@query("flt18_where_documents", " UNION ALL ".join(f"SELECT {k} AS k, c_custkey FROM customer WHERE {sql}" for k, (_, sql) in enumerate(WHERES)))
def where_documents(spark, d):
    t = table(spark, d, "customer")
    return reduce(lambda a, b: a.unionByName(b), [t.filter(PT.matching(spec)).select(F.lit(k).alias("k"), "c_custkey") for k, (spec, _) in enumerate(WHERES)])


@query("flt26_predicate_tree", """
WITH t AS (SELECT c_custkey, c_name, c_acctbal, c_nationkey, 30.0 + (c_custkey % 97) * 0.1 AS lat, 50.0 + (c_custkey % 89) * 0.1 AS lon FROM customer),
 k AS (SELECT *, 2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(lat-35.0)/2),2)+cos(radians(lat))*cos(radians(35.0))*pow(sin(radians(lon-54.0)/2),2)))) AS km FROM t)
SELECT c_custkey FROM k WHERE c_nationkey > 2 AND (km <= 300 OR NOT (c_acctbal BETWEEN 0 AND 4000 OR regexp_matches(c_name, '[05]$'))) AND NOT (c_nationkey IN (5, 6))""")
def predicate_tree(spark, d):
    """A tree with sub-groups, a range, a circle and a pattern, read back from its document."""
    point = F.struct((30.0 + (F.col("c_custkey") % 97) * 0.1).alias("lat"), (50.0 + (F.col("c_custkey") % 89) * 0.1).alias("lon"))
    odd = PT.Group("not", (P.Condition("c_acctbal", "range", (0.0, 4000.0)), P.Condition("c_name", "regex", "[05]$")))
    tree = PT.Group("and", (P.Condition("c_nationkey", "gt", 2),), (PT.Group("or", (P.Condition("place", "geo", (35.0, 54.0, 300.0)),), (odd,)), PT.Group("not", (P.Condition("c_nationkey", "in", (5, 6)),))))
    return table(spark, d, "customer").withColumn("place", point).filter(PT.column(PT.read(PT.document(tree)))).select("c_custkey")
