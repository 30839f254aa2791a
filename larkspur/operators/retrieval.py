"""Retrieval: BM25, cosine search, fusion, decay, diversity, and the cuts that follow."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as V

K1, B = 1.2, 0.75


def bm25(docs: DataFrame, id_col: str, text_col: str, query: list[str], k: int, words: Callable[[Column], Column] = T.ascii_words, rank: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """The k documents that score best for the query's words, ties by id: id, score.

    words: how a text is cut into words; rank: what a score becomes, in the same order. A text's words are found once, and of them only the query's are looked at again; nothing but a row of counts for each
    document that has one is dealt out.
    """
    wanted = [w.lower() for w in dict.fromkeys(query)]
    parted = F.transform(F.array(words(F.col(text_col))), lambda w: F.struct(F.size(w).alias("length"), F.filter(w, lambda x: x.isin(wanted)).alias("hits")))
    d = docs.select(F.col(id_col).alias("id"), F.inline(parted)).where("length > 0")  # what is inlined is computed once
    d = d.select("id", "length", *[_occurrences(w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    stats = d.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted))])
    s = d.where(sum((F.col(f"tf{i}") for i in range(len(wanted))), F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # stats is one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return s.select("id", F.round(rank(score), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _occurrences(word: str) -> Column:
    return F.size(F.filter("hits", lambda x: x == word))


def cosine_topk(vectors: DataFrame, query: list[float], k: int, mode: str = "linear") -> DataFrame:
    """The k vectors nearest to the query: vec_id, label, score."""
    score = V.distance_score(1 - V.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), mode)
    return vectors.select("vec_id", "label", F.round(score, 6).alias("score")).where(~F.isnan("score")).orderBy(F.desc("score"), "vec_id").limit(k)


#: Query vectors that are searched together.
MANY = 4096


def cosine_topk_many(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query_id, vec_id, score: the k vectors nearest to each of at most MANY query vectors of one length, ties to lesser ids.

    The queries go to every task, which compares them with a batch of vectors at once and passes on k a query; vectors of
    another length and those that are zero or not finite take no part.
    """
    if len(queries) > MANY:
        raise ValueError(f"more than {MANY} query vectors")
    ids, unit = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], np.float64)
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), unit.shape[1]), False)
            own, x = batch.column(0).filter(fine).to_numpy(), batch.column(1).filter(fine).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, unit.shape[1])
            norm = np.linalg.norm(x, axis=1)
            stay = np.isfinite(norm) & (norm > 0)
            own, x = own[stay], x[stay] / norm[stay][:, None]
            if not len(own):
                continue
            score = np.round(unit @ x.T, 6)
            order = np.lexsort((np.broadcast_to(own, score.shape), -score), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), order.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(own[order.ravel()]), pa.array(score[rows, order.ravel()])], ["query_id", "vec_id", "score"])

    hits = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).drop("place")


def merge_hits(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.7, text_weight: float = 0.3) -> DataFrame:
    """id, vector_score, text_score, score of hits of either list; a side that is missing scores nothing.

    Both lists are results of searches, k rows each. A keyword snippet wins if there is one.
    """
    both = vector.join(keyword.withColumnRenamed("snippet", "k_snippet") if "snippet" in keyword.columns else keyword, "id", "full_outer")
    both = both.withColumns({"vector_score": F.coalesce("vector_score", F.lit(0.0)), "text_score": F.coalesce("text_score", F.lit(0.0))})
    if "snippet" in vector.columns and "k_snippet" in both.columns:
        both = both.withColumn("snippet", F.coalesce(F.nullif(F.col("k_snippet"), F.lit("")), "snippet")).drop("k_snippet")
    return both.withColumn("score", vector_weight * F.col("vector_score") + text_weight * F.col("text_score"))


def keep_higher(first: DataFrame, second: DataFrame) -> DataFrame:
    """id, score of two lists; for an id in both the higher score, on a tie the second list's: `stage`."""
    both = first.select("id", "score", F.lit(1).alias("stage")).unionByName(second.select("id", "score", F.lit(2).alias("stage")))
    return both.groupBy("id").agg(F.max(F.struct("score", "stage")).alias("m")).select("id", "m.score", "m.stage")


def mmr_order(scores: list[float], texts: list[str], weight: float) -> list[int]:
    """Greedy order by weight * relevance - (1 - weight) * the greatest likeness to what is chosen; ties to higher scores."""
    if len(scores) < 2:
        return list(range(len(scores)))
    weight = min(1.0, max(0.0, weight))
    if weight == 1:
        return sorted(range(len(scores)), key=lambda i: -scores[i])
    words = [set(re.findall("[a-z0-9_]+", t.lower())) for t in texts]
    low, high = min(scores), max(scores)
    relevance = [(s - low) / (high - low) if high > low else 1.0 for s in scores]
    like, chosen, rest = [0.0] * len(scores), [], list(range(len(scores)))
    while rest:
        best = max(rest, key=lambda i: (weight * relevance[i] - (1 - weight) * like[i], scores[i], -i))
        chosen.append(best)
        rest.remove(best)
        for i in rest:
            a, b = words[i], words[best]
            same = 1.0 if not a and not b else len(a & b) / len(a | b)
            like[i] = max(like[i], same)
    return chosen


def mmr(hits: DataFrame, by: str, weight: float = 0.7) -> DataFrame:
    """hits (id, score, text and `by`) of each query with their place in the diverse order. A query's hits are few: a search's k."""
    schema = f"{by} {hits.schema[by].dataType.simpleString()}, id long, score double, place int"

    def order(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        chosen = mmr_order(g["score"].tolist(), g["text"].fillna("").tolist(), weight)
        return g.iloc[chosen].assign(place=range(1, len(g) + 1))[[by, "id", "score", "place"]]

    return hits.select(by, F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), "text").groupBy(by).applyInPandas(lambda g: order(g), schema)


def boosted(hits: DataFrame, query: str, now: Column | None = None) -> DataFrame:
    """hits (score, content, and modified if given) with score raised by matching words and recency, at most 1."""
    words = [w for w in query.lower().split() if len(w) > 2]
    matches = sum((F.when(F.contains(F.lower("content"), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
    score = F.col("score") + F.least(matches * 0.1, F.lit(0.3))
    if now is not None:
        days = (F.unix_timestamp(now) - F.unix_timestamp("modified")) / 86400
        score = score + F.coalesce(F.greatest(F.lit(0.0), (30 - days) / 30) * 0.2, F.lit(0.0))
    return hits.withColumn("score", F.least(score, F.lit(1.0)))


def lexical(content: Column, query: str, stop: set[str] = frozenset()) -> Column:
    """0.95 for the whole phrase; else by the share of the query's words found: from a half on 0.3 more (at most 0.9), less 0.7 of it."""
    words = [w for w in query.lower().split() if len(w) > 2 and w not in stop]
    low = F.lower(content)
    if not words:
        return F.lit(0.95)
    share = sum((F.when(F.contains(low, F.lit(w)), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / len(words)
    return F.when(F.contains(low, F.lit(" ".join(words))), 0.95).when(share >= 0.5, F.least(share + 0.3, F.lit(0.9))).otherwise(share * 0.7)


# Share kept, least score and most rows by level.
LEVELS = {"focused": (0.3, 0.6, 10), "moderate": (0.6, 0.3, 25), "general": (1.0, 0.1, 50)}


# Tokens of context by level.
BUDGETS = {"focused": 1000, "moderate": 2500, "general": 4000}


def room(level: Column, used: Column) -> Column:
    """Tokens that are left of a level's budget, none if it is used up; null for an unknown level."""
    budget = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in BUDGETS.items()])
    return F.when(budget.isNotNull(), F.greatest(F.lit(0), budget - F.coalesce(used, F.lit(0))))


def packed_by_level(hits: DataFrame, by: str) -> DataFrame:
    """packed() with the budget that each row's `level` names."""
    parts = [packed(hits.where(F.col("level") == k), by, v) for k, v in BUDGETS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Sessions that a usage query reads if it does not say, and the most that it may ask for.
FAN_OUT, MOST_FAN_OUT = 50, 1000


def fanned_out(sessions: DataFrame, order: list, limit: int | None = None) -> DataFrame:
    """The sessions that a usage query reads: the first FAN_OUT in order, or so many as it asks for, MOST_FAN_OUT at most."""
    return sessions.orderBy(*order).limit(min(MOST_FAN_OUT, max(1, FAN_OUT if limit is None else limit)))


def slowest(results: DataFrame, limit: int) -> DataFrame:
    """file, duration of the files (file, start, end) that took longest; a file that ends before it starts took no time."""
    took = F.greatest(F.lit(0), F.coalesce("end", F.lit(0)) - F.coalesce("start", F.lit(0)))
    return results.select("file", took.alias("duration")).orderBy(F.desc("duration"), "file").limit(limit)


def cut(hits: DataFrame, by: str, level: str, threshold: float | None = None, most: int | None = None) -> DataFrame:
    """The best hits of each query: the level's share first, then its least score, then at most so many."""
    share, least, limit = LEVELS[level]
    least, limit = least if threshold is None else threshold, limit if most is None else most
    w = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    top = hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)  # cut in each task before it is dealt out
    if share < 1:
        sizes = hits.groupBy(by).agg(F.count("*").alias("n"))
        top = top.join(sizes, by).where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * share, 6)))).drop("n")
    return top.where(F.col("score") >= least)


def pieces(rows: DataFrame) -> int:
    """In how many pieces a group's rows are looked at first, each of which keeps what may be within the budget: as many as the
    session deals rows out to, so that a group with most of them is the work of all tasks."""
    return max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _within(rows: DataFrame, by: str, order: list, size: Column, budget: int) -> DataFrame:
    """rows with `before`: the sizes of all rows of the group before them, of those that begin within the budget.

    What begins beyond it in a piece of its group does so in the group; so pieces are cut first, in tasks of their own,
    and one task gets few rows of a group however large it is.
    """
    piece = rows.withColumns({"size_": size, "piece_": F.pmod(F.xxhash64("id"), F.lit(pieces(rows)))})
    upto = lambda *keys: F.coalesce(F.sum("size_").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    few = piece.withColumn("before", upto(by, "piece_")).where(F.col("before") <= budget)
    return few.withColumn("before", upto(by)).where(F.col("before") <= budget).drop("piece_")


def packed(hits: DataFrame, by: str, limit: int) -> DataFrame:
    """Hits in order of score until the first that would go beyond `limit` tokens (a quarter of the characters)."""
    d = _within(hits, by, [F.desc("score"), F.col("id")], T.estimated_tokens(F.col("content")), limit)
    return d.withColumn("used", F.col("before") + F.col("size_")).where(F.col("used") <= limit).withColumnRenamed("size_", "tokens").drop("before")


def clamped(hits: DataFrame, by: str, budget: int) -> DataFrame:
    """Whole snippets while there is room; the one that crosses the budget is cut, the rest go."""
    d = _within(hits, by, [F.desc("score"), F.col("id")], F.length("snippet"), budget).withColumn("room", F.lit(budget) - F.col("before"))
    return d.where(F.col("room") > 0).withColumn("snippet", F.col("snippet").substr(F.lit(1), F.col("room").cast("int"))).drop("room", "before", "size_")


def decayed(hits: DataFrame, stamp: str, now: Column, half_life: float = 30.0) -> DataFrame:
    """Scores halved every half_life days of age; a null time does not decay."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(stamp).cast("timestamp"))) / (86400 * 1e6)
    return hits.withColumn("score", F.when(F.col(stamp).isNull(), F.col("score")).otherwise(V.decay(F.col("score"), age, half_life)))


