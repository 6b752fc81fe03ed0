"""All registered queries of the core engine, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamiz.plans import model_queries, record_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {**text_queries.QUERIES, **record_queries.QUERIES, **model_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**text_queries.ORACLE_SQL, **record_queries.ORACLE_SQL, **model_queries.ORACLE_SQL}
FLAGSHIP = "train_evaluate"
