"""Vectors as arrays, and the scores made of distances and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Zero for zero vectors."""
    n = F.least(F.size(a), F.size(b))
    length = norm(F.slice(a, F.lit(1), n)) * norm(F.slice(b, F.lit(1), n))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def normalise(a: Column) -> Column:
    """To length one; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def distance_score(distance: Column, mode: str = "linear") -> Column:
    """`linear`: 1 - d; `half`: 1 - d / 2."""
    return 1 - (distance if mode == "linear" else distance / 2)


def rank_score(rank: Column) -> Column:
    """1 / (1 + rank), ranks below zero count as zero."""
    return 1 / (1 + F.greatest(F.coalesce(rank, F.lit(999.0)), F.lit(0.0)))


def bm25_score(rank: Column, compat: bool = False) -> Column:
    """A better (more negative) rank scores higher; with compat lower, as 1 + clamp(rank, -100, 0) / 100."""
    held = F.greatest(F.lit(-100.0), F.least(F.lit(0.0), rank))
    return 1 + held / 100 if compat else -held / 100


def decay(score: Column, age_days: Column, half_life: float) -> Column:
    """Halved every half_life days; ages below zero count as zero; without a half life nothing decays."""
    if half_life <= 0:
        return score
    return score * F.exp(-F.ln(F.lit(2.0)) / half_life * F.greatest(F.lit(0.0), age_days))


def path_date(path: Column) -> Column:
    """The date in `memory/YYYY-MM-DD.md`; null for no such path or no such day."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    return F.try_to_date(F.nullif(F.regexp_extract(clean, r"(?:^|/)memory/(\d{4}-\d{2}-\d{2})\.md$", 1), F.lit("")), "yyyy-MM-dd")


def evergreen(path: Column) -> Column:
    """Memory files without a date never decay."""
    clean = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")
    return clean.isin("MEMORY.md", "memory.md") | (clean.startswith("memory/") & ~clean.rlike(r"(?:^|/)memory/\d{4}-\d{2}-\d{2}\.md$"))
