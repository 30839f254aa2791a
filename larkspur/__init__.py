"""Retrieval, usage-analytics and stream operators as Spark DataFrame transformations."""
