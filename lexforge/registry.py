"""The queries of the engine and their SQL, collected from the modules of `plans`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexforge.plans import catalogue_queries, document_queries, index_queries, listing_queries, rule_queries, search_queries, text_queries

MODULES = (text_queries, search_queries, document_queries, listing_queries, catalogue_queries, rule_queries, index_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.search_hybrid(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
