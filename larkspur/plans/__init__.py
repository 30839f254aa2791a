"""Queries over the driver tables and their SQL counterparts."""
