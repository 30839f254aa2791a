"""All queries by name, with their SQL."""

from __future__ import annotations

from larkspur.plans import graph_queries, history_queries, memory_queries, reader_queries, retrieval_queries, source_queries, stream_queries, text_queries, usage_queries
from larkspur.plans.registry import Query

PARTS = [retrieval_queries.R, text_queries.R, usage_queries.R, history_queries.R, memory_queries.R, graph_queries.R, stream_queries.R, source_queries.R, reader_queries.R]


def queries() -> dict[str, Query]:
    return {k: q for r in PARTS for k, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for r in PARTS for k, q in r.sql.items()}
