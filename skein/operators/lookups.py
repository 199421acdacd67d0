"""Table functions of SQL: look-ups of keys and sessions by arguments, and a tenant's rows.

Each is a function of the session that returns a table; Catalyst puts its body in place of the call, so a call with literals
filters the scan and a lateral call is a join.  A revoked or inactive entry isn't found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keys_of(customers: DataFrame) -> DataFrame:
    """API keys: one a customer, of the customer's nation as tenant; those in debt are inactive."""
    key = F.concat(F.lit("key-"), F.col("c_custkey").cast("string"))
    return customers.select(key.alias("key_id"), F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.sha2(key, 256).alias("key_hash"), F.substring(F.sha2(key, 256), 1, 8).alias("key_prefix"), F.lower("c_mktsegment").alias("permissions"), (F.col("c_acctbal") >= 0).alias("is_active"))


def sessions_of(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Sessions: one an order; finished ones are revoked a day later."""
    token = F.md5(F.concat(F.lit("token-"), F.col("o_orderkey").cast("string")))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("session_id"), token.alias("token_hash"), F.col("c_nationkey").alias("tenant_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("revoked_at"))


FUNCTIONS = {
    "lookup_key": (
        "p_key STRING, p_active_only BOOLEAN DEFAULT true",
        "key_id STRING, tenant_id INT, user_id BIGINT, name STRING, key_hash STRING, key_prefix STRING, permissions STRING, is_active BOOLEAN",
        "SELECT key_id, tenant_id, user_id, name, key_hash, key_prefix, permissions, is_active FROM tenant_keys AS k WHERE k.key_id = p_key AND (k.is_active OR NOT p_active_only)",
    ),
    "lookup_session": (
        "p_token STRING, p_revoked_too BOOLEAN DEFAULT false",
        "session_id BIGINT, tenant_id INT, user_id BIGINT, created_at TIMESTAMP_NTZ, revoked_at TIMESTAMP_NTZ",
        "SELECT session_id, tenant_id, user_id, created_at, revoked_at FROM tenant_sessions AS s WHERE s.token_hash = p_token AND (s.revoked_at IS NULL OR p_revoked_too)",
    ),
    "tenant_rows": (
        "p_tenant INT, p_admin BOOLEAN DEFAULT false",
        "session_id BIGINT, tenant_id INT, user_id BIGINT",
        "SELECT session_id, tenant_id, user_id FROM tenant_sessions AS s WHERE s.tenant_id = p_tenant OR p_admin",
    ),
}


def register(spark: SparkSession, keys: DataFrame, sessions: DataFrame) -> None:
    """Makes the functions over these tables known to the session."""
    keys.createOrReplaceTempView("tenant_keys")
    sessions.createOrReplaceTempView("tenant_sessions")
    for name, (arguments, columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body}")
