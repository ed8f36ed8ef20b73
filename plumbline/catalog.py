"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import context_queries, document_queries, graph_queries, search_queries, text_queries

FAMILIES = [text_queries, search_queries, graph_queries, context_queries, document_queries]

FLAGSHIP = "o115_rrf_top10"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
