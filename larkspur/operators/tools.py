"""What an agent calls by name: search and reading of memories, with the method of a search chosen by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as V
from larkspur.operators import retrieval

#: What a search does if nothing chooses, or what chooses fails or says something else.
HYBRID = {"method": "hybrid", "vector_weight": 0.7, "text_weight": 0.3}


def chosen(query: str, choose: Callable[[str], dict] | None) -> dict:
    """The strategy that `choose` tells for a query: method (vector, keyword or hybrid) and weights; else HYBRID."""
    try:
        told = dict(HYBRID, **choose(query)) if choose else HYBRID
        fine = told["method"] in ("vector", "keyword", "hybrid") and min(float(told["vector_weight"]), float(told["text_weight"])) >= 0
    except Exception:  # what chooses is not ours; a search goes on without it
        fine = False
    return told if fine else HYBRID


def memory_search(chunks: DataFrame, query: str, vector: list[float] | None = None, k: int = 10, choose: Callable[[str], dict] | None = None) -> DataFrame:
    """id, score of the k best of chunks (id, text, embedding) for a query, by words, by vector or by both."""
    s = chosen(query, choose)
    words = [w for w in dict.fromkeys(query.lower().split()) if w]
    keyword = retrieval.bm25(chunks, "id", "text", words, k).select("id", V.rank_score(10 - F.col("score")).alias("text_score")) if words else None
    near = retrieval.cosine_topk(chunks.withColumns({"vec_id": F.col("id"), "label": F.lit(0)}), vector, k).select(F.col("vec_id").alias("id"), F.col("score").alias("vector_score")) if vector else None
    if s["method"] == "vector" and near is not None or keyword is None and near is not None:
        hits = near.withColumnRenamed("vector_score", "score")
    elif near is None or s["method"] == "keyword":
        hits = keyword.withColumnRenamed("text_score", "score") if keyword is not None else chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    else:
        hits = retrieval.merge_hits(near, keyword, s["vector_weight"], s["text_weight"]).select("id", "score")
    return hits.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def memory_get(files: DataFrame, path: str, start: int = 1, count: int | None = None) -> DataFrame:
    """path, text of a file (path, text), or of `count` lines from line `start` on."""
    d = files.where(F.col("path") == path)
    return d.select("path", T.line_range(F.col("text"), start, 1_000_000_000 if count is None else count).alias("text"))


TOOLS: dict[str, Callable[..., DataFrame]] = {"memory_search": memory_search, "memory_get": memory_get}
