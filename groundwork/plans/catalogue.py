"""Registry of the library's queries over the driver tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundwork.plans import answer_queries, document_queries, evaluation_queries, event_queries, pipeline_queries, service_queries, store_queries, stream_queries

ALL = document_queries.QUERIES | answer_queries.QUERIES | event_queries.QUERIES | service_queries.QUERIES | evaluation_queries.QUERIES | pipeline_queries.QUERIES | stream_queries.QUERIES | store_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_queries.hybrid_rrf(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
