"""Joins of rows with what is known of their keys, where one key may have a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task can take.
TASK_ROWS = 1 << 20


def with_facts(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """left joined with right, which has one row for a key.

    Keys with more than task_rows rows of left, of which there can be no more than left has tasks, meet their facts in a
    broadcast, and their rows stay where they are; the others are dealt out by key. counts (keys, count): how many rows left has
    of each key, if that is known. left is read twice, so it should be a written table.
    """
    counts = left.groupBy(*keys).count() if counts is None else counts
    many = F.broadcast(counts.where(F.col("count") > task_rows).select(*keys))
    hot = left.join(many, keys, "left_semi").join(F.broadcast(right.join(many, keys, "left_semi")), keys, how)
    return hot.unionByName(left.join(many, keys, "left_anti").join(right, keys, how))
