"""All queries of the library proper, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.plans import aggregate_queries, answer_queries, deeper_queries, event_queries, extra_queries, filter_queries, more_queries, reading_queries, report_queries, retrieval_queries, span_queries, store_queries  # noqa: F401  they register themselves
from skein.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation: three joins and an aggregate."""
    return QUERIES["jon01_inner_top"](spark, sf_dir)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
