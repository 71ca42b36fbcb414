"""The named queries of the library and the same queries in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphsift.plans import carrier_queries, corpus_queries, keyed_queries, rewrite_queries, synthetic_queries

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (carrier_queries, rewrite_queries, keyed_queries, corpus_queries, synthetic_queries)


def queries() -> dict[str, Query]:
    return {name: q for part in PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
