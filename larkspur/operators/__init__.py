"""Relational operators: joins, windows, aggregations, ranking, graph."""
