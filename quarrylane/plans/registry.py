"""All queries and their SQL outside the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylane.plans import corpus_queries, lineage_queries, migrate_queries, naming_queries, packed_queries, profile_queries, rewrite_queries, shape_queries, statement_queries

MODULES = [packed_queries, profile_queries, statement_queries, shape_queries, corpus_queries, naming_queries, lineage_queries, migrate_queries, rewrite_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
