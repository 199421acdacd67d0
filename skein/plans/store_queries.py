"""Stores that are written, changed and read back; counted updates and deletes; row policies; reports on tenants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from skein.operators import lookups as L
from skein.operators import store as T
from skein.operators import versions as VS
from skein.plans.registry import query, table
from skein.sources import versioned


@query("snk01_05_add_delete", "SELECT c_custkey, c_acctbal FROM customer WHERE (c_custkey%2=0 OR c_acctbal<0) AND c_mktsegment<>'BUILDING'")
def add_delete(spark, d):
    all_ = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    first = T.load(spark, T.save(all_.filter("c_custkey % 2 = 0"), "c_custkey"))
    second = T.load(spark, T.save(T.add(first, all_.filter("c_acctbal < 0"), "c_custkey"), "c_custkey"))
    left, _ = T.delete_where(second, F.col("c_mktsegment") == "BUILDING")
    return T.load(spark, T.save(left, "c_custkey")).drop("c_mktsegment")


@query("snk06_clear_tenant", "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey <> 3 GROUP BY 1")
def clear(spark, d):
    stored = T.load(spark, T.save(table(spark, d, "customer"), "c_custkey"))
    left, _ = T.delete_where(stored, F.col("c_nationkey") == 3)
    return T.load(spark, T.save(left, "c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("snk07_persist_load", "SELECT vec_id, label, len(embedding) AS dimensions FROM embeddings")
def persist(spark, d):
    return T.load(spark, T.save(table(spark, d, "embeddings"), "vec_id")).select("vec_id", "label", F.size("embedding").cast("long").alias("dimensions"))


@query("snk08_add_chunks", "SELECT doc_id, CASE WHEN lang='en' THEN 'prose' ELSE 'text' END AS chunk_type, lang='de' AS is_semantic, CASE WHEN lang='fr' THEN n_chars ELSE length(text) END AS chunk_length FROM documents")
def add_chunks(spark, d):
    given = F.map_filter(F.create_map(F.lit("chunk_type"), F.when(F.col("lang") == "en", "prose"), F.lit("is_semantic"), F.when(F.col("lang") == "de", "true"), F.lit("chunk_length"), F.when(F.col("lang") == "fr", F.col("n_chars").cast("string"))), lambda k, v: v.isNotNull())
    return T.chunk_rows(table(spark, d, "documents").withColumn("m", given), "text", "m").select("doc_id", "chunk_type", "is_semantic", F.col("chunk_length").cast("long").alias("chunk_length"))


@query("snk09_10_copy_with_faults", "SELECT o_orderkey, CASE WHEN o_orderpriority='5-LOW' AND o_totalprice>150000 THEN 'missing' ELSE 'differs' END AS fault FROM orders WHERE o_orderstatus='P' OR (o_orderpriority='5-LOW' AND o_totalprice>150000)")
def copy_with_faults(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    damaged = rows.filter(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_totalprice") > 150000))).withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    copied = T.load(spark, T.save(damaged, "o_orderkey")).select("o_orderkey", F.xxhash64("o_totalprice", "o_orderstatus", "o_orderpriority").alias("h"))
    own = rows.select("o_orderkey", F.xxhash64("o_totalprice", "o_orderstatus", "o_orderpriority").alias("own"))
    fault = F.when(F.col("h").isNull(), "missing").when(F.col("h") != F.col("own"), "differs")
    return own.join(copied, "o_orderkey", "left").select("o_orderkey", fault.alias("fault")).filter("fault is not null")


@query("sql03_group_count", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")
def group_count(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("sql01_07_08_rows", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31' AND o_orderpriority LIKE '%LOW' ORDER BY o_orderdate, o_orderkey")
def rows_in_order(spark, d):
    dates = F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1995-03-31").cast("timestamp"))
    return table(spark, d, "orders").filter(dates & F.col("o_orderpriority").like("%LOW")).select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("sql05_composite_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey=7 AND c_mktsegment='AUTOMOBILE' ORDER BY c_custkey LIMIT 1")
def composite(spark, d):
    return table(spark, d, "customer").filter("c_nationkey = 7 AND c_mktsegment = 'AUTOMOBILE'").orderBy("c_custkey").limit(1).select("c_custkey", "c_name")


@query("sql09_11_update_returning", "SELECT c_nationkey, count(*) AS changed, round(sum(-c_acctbal),2) AS written_off FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def update_returning(spark, d):
    store = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lit(0.0).alias("written_off"))
    after, changed = T.update(store, F.col("c_acctbal") < 0, {"written_off": -F.col("c_acctbal"), "c_acctbal": F.lit(0.0)})
    stored = T.load(spark, T.save(after, "c_custkey"))
    # The counts come from what was returned, the sums from what was stored.
    sums = stored.groupBy("c_nationkey").agg(F.round(F.sum("written_off"), 2).alias("written_off"))
    return changed.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("changed")).join(sums, "c_nationkey")


@query("sql10_evt38_delete_expired", "WITH m AS (SELECT max(o_orderdate) AS as_of FROM orders) SELECT o_orderstatus, count(*) FILTER (WHERE o_orderdate + INTERVAL 365 DAY <= as_of) AS gone, count(*) FILTER (WHERE o_orderdate + INTERVAL 365 DAY > as_of) AS kept FROM orders, m GROUP BY 1")
def delete_expired(spark, d):
    orders = table(spark, d, "orders")
    dated = orders.join(F.broadcast(orders.agg(F.max("o_orderdate").alias("as_of")))).select("o_orderkey", "o_orderstatus", "as_of", (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expires"))
    left, gone = T.delete_where(dated, F.col("expires") <= F.col("as_of"))
    stored = T.load(spark, T.save(left, "o_orderkey"))
    n = lambda df, name: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias(name))
    return n(gone, "gone").join(n(stored, "kept"), "o_orderstatus", "full").fillna(0)


@query("sql13_row_policy", "SELECT c_custkey, 'tenant' AS reader FROM customer WHERE c_nationkey = 5 UNION ALL SELECT c_custkey, 'admin' FROM customer")
def row_policy(spark, d):
    rows = table(spark, d, "customer")
    seen = lambda who, admin: T.visible(rows, "c_nationkey", 5, admin).select("c_custkey", F.lit(who).alias("reader"))
    return seen("tenant", False).unionByName(seen("admin", True))


@query("evt35_performance_score", "SELECT user_id, round((greatest(0,100-avg(value)/10*10)+greatest(0,100-100*avg(CASE WHEN event_type='error' THEN 1.0 ELSE 0 END))+20*5*avg(CASE WHEN event_type='purchase' THEN 1.0 ELSE 0 END))/3,4) AS score FROM events GROUP BY 1")
def performance(spark, d):
    share = lambda kind: F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
    usage = table(spark, d, "events").groupBy("user_id").agg((F.avg("value") / 10).alias("response"), share("error").alias("errors"), (5 * share("purchase")).alias("satisfaction"))
    terms = F.greatest(F.lit(0.0), 100 - F.col("response") * 10) + F.greatest(F.lit(0.0), 100 - F.col("errors") * 100) + F.col("satisfaction") * 20
    return usage.select("user_id", F.round(terms / 3, 4).alias("score"))


@query("evt40_utilisation_bands", "SELECT l_suppkey, CASE WHEN u BETWEEN 60 AND 70 THEN 100 WHEN u BETWEEN 50 AND 80 THEN 80 WHEN u BETWEEN 40 AND 90 THEN 60 ELSE 30 END AS utilisation FROM (SELECT l_suppkey, 100.0*count(*) FILTER (WHERE l_quantity > 18)/count(*) AS u FROM lineitem GROUP BY 1)")
def utilisation(spark, d):
    u = F.col("u")
    bands = F.when(u.between(60, 70), 100).when(u.between(50, 80), 80).when(u.between(40, 90), 60).otherwise(30)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg((100.0 * F.count_if(F.col("l_quantity") > 18) / F.count(F.lit(1))).alias("u")).select("l_suppkey", bands.alias("utilisation"))


@query("evt45_component_roll_up", """WITH c AS (SELECT n_regionkey, n_name, CASE WHEN avg(c_acctbal) < 4200 THEN 'unhealthy' WHEN avg(c_acctbal) < 4500 THEN 'degraded' ELSE 'healthy' END AS s FROM customer JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2)
SELECT n_regionkey, CASE WHEN bool_or(n_name IN ('GERMANY','CHINA','BRAZIL') AND s='unhealthy') THEN 'unhealthy' WHEN bool_or(s <> 'healthy') THEN 'degraded' ELSE 'healthy' END AS status FROM c GROUP BY 1""")
def roll_up(spark, d):
    nations = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    mean = F.avg("c_acctbal")
    parts = nations.groupBy("n_regionkey", "n_name").agg(F.when(mean < 4200, "unhealthy").when(mean < 4500, "degraded").otherwise("healthy").alias("s"))
    critical = F.bool_or(F.col("n_name").isin("GERMANY", "CHINA", "BRAZIL") & (F.col("s") == "unhealthy"))
    return parts.groupBy("n_regionkey").agg(F.when(critical, "unhealthy").when(F.bool_or(F.col("s") != "healthy"), "degraded").otherwise("healthy").alias("status"))


@query("evt48_audit_report", "SELECT c_custkey, count(o_orderkey) AS activities, count(DISTINCT o_orderpriority) AS kinds, round(count(*) FILTER (WHERE o_orderstatus='F')/nullif(count(o_orderkey),0),6) AS success_rate, max(o_orderdate) AS last_seen FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def audit(spark, d):
    kinds = [F.bool_or(F.col("o_orderpriority") == p).cast("int") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
    logs = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("activities"), reduce(lambda a, b: a + b, kinds).alias("kinds"), F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.max("o_orderdate").alias("last_seen"))
    users = table(spark, d, "customer").select("c_custkey").join(logs, F.col("c_custkey") == F.col("o_custkey"), "left")
    return users.select("c_custkey", F.coalesce("activities", F.lit(0)).alias("activities"), F.coalesce(F.col("kinds").cast("long"), F.lit(0)).alias("kinds"), F.round(F.col("good") / F.col("activities"), 6).alias("success_rate"), "last_seen")


@query("evt03_usage_pattern", "WITH s AS (SELECT user_id, date_trunc('day',ts) AS day, count(*) AS n, epoch(max(ts))-epoch(min(ts)) AS sec FROM events GROUP BY 1,2), u AS (SELECT user_id, avg(sec) AS a, avg(n) AS q FROM s GROUP BY 1) SELECT user_id, CASE WHEN a > 1800 AND q > 10 THEN 'power_user' WHEN a > 600 AND q > 5 THEN 'regular_user' WHEN q > 2 THEN 'casual_user' ELSE 'light_user' END AS pattern FROM u")
def usage_pattern(spark, d):
    at = F.col("ts").cast("timestamp")
    seconds = F.unix_micros(F.max(at)) / 1e6 - F.unix_micros(F.min(at)) / 1e6
    days = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), seconds.alias("sec"))
    a, q = F.avg("sec"), F.avg("n")
    pattern = F.when((a > 1800) & (q > 10), "power_user").when((a > 600) & (q > 5), "regular_user").when(q > 2, "casual_user").otherwise("light_user")
    return days.groupBy("user_id").agg(pattern.alias("pattern"))


@query("evt23_query_evolution", """WITH q AS (SELECT conv_id, len(list_filter(string_split_regex(text,'\\s+'), lambda x: x <> '')) AS n FROM conversations WHERE role='user')
SELECT conv_id, CASE WHEN count(*) FILTER (WHERE n > 8) > count(*) FILTER (WHERE n <= 3) THEN 'increasing' ELSE 'decreasing' END AS trend, round(count(*) FILTER (WHERE n > 8)/count(*),6) AS complexity FROM q GROUP BY 1""")
def evolution(spark, d):
    n = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    long, short = F.count_if(n > 8), F.count_if(n <= 3)
    return table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.when(long > short, "increasing").otherwise("decreasing").alias("trend"), F.round(long / F.count(F.lit(1)), 6).alias("complexity"))


@query("snk13_16_restore", "SELECT p_partkey, p_size FROM part WHERE p_size > 10")
def restore(spark, d):
    first = T.save(table(spark, d, "part").select("p_partkey", "p_size").filter("p_size > 10"), "p_partkey")
    # A copy to another provider that was never finished: its version has no rows that can be read.
    return T.restored(spark, [first, f"{first}-unfinished"])


@query("snk15_export_import", "SELECT event_id, event_type, user_id FROM events")
def export_import(spark, d):
    cache = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return T.import_json(spark, T.export_json(cache), cache.schema)


def _planted(at: int):
    """Refuses one row, as a store does that can't take it."""
    return lambda rows: rows.withColumn("text", F.when(F.col("doc_id") == at, F.raise_error(F.lit("planted"))).otherwise(F.col("text")))


#: Rows of a migration's batch.
BATCH = 250


@query("snk16_migration_rollback", f"""
WITH d AS (SELECT count(*) AS n, count(*) FILTER (doc_id < (SELECT max(doc_id) // 2 FROM documents)) AS place FROM documents),
 b AS (SELECT n, place // {BATCH} * {BATCH} AS done, least({BATCH}, n - 1 - place // {BATCH} * {BATCH}) AS failed FROM d)
SELECT 1 AS attempt, 'rolled_back' AS status, done AS migrated, failed, done AS rolled_back, 1 AS version, 1 AS target_count, n - 1 AS mismatches FROM b UNION ALL SELECT 2, 'ok', n - 1, 0, 0, 2, n, 0 FROM b""")
def migration_rollback(spark, d):
    """All but one document move to a store that holds it: first with a planted failure, then without."""
    docs = table(spark, d, "documents")
    at, last = docs.agg((F.max("doc_id") / 2).cast("long"), F.max("doc_id")).first()
    folder = VS.new_store(spark)
    VS.write(docs.filter(F.col("doc_id") == last), folder, "before")
    rows = []
    for attempt, change in ((1, _planted(at)), (2, None)):
        said = VS.migrate(docs.filter(F.col("doc_id") != last), folder, "doc_id", BATCH, change)
        found = VS.compared(docs, VS.read(spark, folder), "doc_id").first()
        rows.append((attempt, said["status"], said["migrated"], said["failed"], said["rolled_back"], said["version"], said["target_count"], found.mismatches))
    return spark.createDataFrame(rows, "attempt int, status string, migrated long, failed long, rolled_back long, version long, target_count long, mismatches long")


@query("snk13_versions_verified", "SELECT 1 AS version, 'first' AS note, 1 AS groups, count(*) FILTER (doc_id % 2 = 0) AS rows, 0 AS damaged FROM documents UNION ALL SELECT 2, 'second', 2, count(*), 1 FROM documents UNION ALL SELECT 3, 'rolled back', 1, count(*) FILTER (doc_id % 2 = 0), 0 FROM documents")
def versions_verified(spark, d):
    """Two versions, a group of the second exchanged for other rows, and a return to the first: groups by checksum."""
    docs, folder = table(spark, d, "documents"), VS.new_store(spark)
    VS.write(docs.filter("doc_id % 2 = 0"), folder, "first")
    VS.write(docs.filter("doc_id % 2 = 1"), folder, "second", append=True)
    docs.filter("doc_id % 2 = 1").withColumn("text", F.reverse("text")).write.mode("overwrite").parquet(VS.manifest(folder)["groups"][1]["path"])
    VS.roll_back(folder, 1)
    bad = spark.createDataFrame([(v, len(VS.verify(spark, folder, v))) for v in VS.versions(folder)], "version long, damaged int")
    return VS.history(spark, folder).join(bad, "version")


@query("udf04_store_by_format", "SELECT lang, count(*) AS docs, sum(n_chars) AS chars, min(doc_id) AS first FROM documents WHERE n_chars >= 500 AND lang IN ('en', 'fr') GROUP BY lang")
def store_by_format(spark, d):
    """Documents written and read again by the store's own format, in two versions, with filters pushed to it."""
    versioned.register(spark)
    docs, folder = table(spark, d, "documents"), VS.new_store(spark)
    docs.filter("doc_id % 3 = 0").write.format("versions").option("path", folder).mode("append").save()
    docs.filter("doc_id % 3 <> 0").write.format("versions").option("path", folder).mode("append").save()
    held = spark.read.format("versions").option("path", folder).load()
    return held.filter("n_chars >= 500 AND lang IN ('en', 'fr')").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))


def _lookups(spark, d):
    customers = table(spark, d, "customer")
    L.register(spark, L.keys_of(customers), L.sessions_of(table(spark, d, "orders"), customers))


@query("sql12_session_lookups", "SELECT o_orderkey AS asked, o_custkey AS user_id, c_nationkey AS tenant_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 = 0 AND o_orderstatus <> 'F'")
def session_lookups(spark, d):
    """Tokens looked up by a table function for each row; revoked sessions aren't found."""
    _lookups(spark, d)
    table(spark, d, "orders").createOrReplaceTempView("asked_orders")
    return spark.sql("SELECT o.o_orderkey AS asked, s.user_id, s.tenant_id FROM asked_orders o, LATERAL lookup_session(md5('token-' || o.o_orderkey)) s WHERE o.o_orderkey % 7 = 0")


@query("sql12_key_lookup", """SELECT 'active' AS what, 'key-'||c_custkey AS key_id, c_nationkey AS tenant_id, substr(sha256('key-'||c_custkey),1,8) AS key_prefix FROM customer WHERE c_custkey IN (3, 4, 5) AND c_acctbal >= 0
UNION ALL SELECT 'any', 'key-'||c_custkey, c_nationkey, substr(sha256('key-'||c_custkey),1,8) FROM customer WHERE c_custkey IN (3, 4, 5)""")
def key_lookup(spark, d):
    """Three keys by literal arguments, with and without inactive ones."""
    _lookups(spark, d)
    one = lambda what, k, active: f"SELECT '{what}' AS what, key_id, tenant_id, key_prefix FROM lookup_key('key-{k}', {active})"
    return spark.sql(" UNION ALL ".join(one(what, k, active) for what, active in (("active", "true"), ("any", "false")) for k in (3, 4, 5)))


@query("sql12_tenant_rows", "SELECT 'tenant' AS who, count(*) AS n, count(DISTINCT o_custkey) AS users FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 UNION ALL SELECT 'admin', count(*), count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey")
def tenant_rows(spark, d):
    _lookups(spark, d)
    return spark.sql("SELECT 'tenant' AS who, count(*) AS n, count(DISTINCT user_id) AS users FROM tenant_rows(3) UNION ALL SELECT 'admin', count(*), count(DISTINCT user_id) FROM tenant_rows(3, true)")
