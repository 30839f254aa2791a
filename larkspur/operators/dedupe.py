"""Near-equal texts: greedy within a group, and joins on shared words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.scratch import written


def greedy(memories: DataFrame, by: str, threshold: float = 0.85) -> DataFrame:
    """Of each group, in order of id, the rows that are left when each near-equal one is merged into the first it is like.

    A merge keeps the row with the higher score, or else the later one; the place is the first row's. A group is a
    query's candidates, so it is small; for whole tables use similar_pairs.
    """

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        seen: dict[int, int] = {}
        rows = g.sort_values("id", kind="stable").reset_index(drop=True)
        words = [{w for w in (t or "").lower().split() if len(w) > 2} for t in rows["content"]]
        for i in range(len(rows)):
            for first, best in seen.items():
                a, b = words[i], words[best]
                alike = rows.at[i, "content"] == rows.at[best, "content"] or bool(a and b) and len(a & b) / len(a | b) >= threshold
                if alike:
                    x, y = rows.loc[best], rows.loc[i]
                    if y["score"] > x["score"] or y["score"] == x["score"] and y["ts"] > x["ts"]:
                        seen[first] = i
                    break
            else:
                seen[i] = i
        return rows.loc[list(seen.values()), [by, "id"]].assign(first=[rows.at[k, "id"] for k in seen])

    kind = memories.schema[by].dataType.simpleString()
    return memories.select(by, F.col("id").cast("long").alias("id"), "content", F.col("score").cast("double").alias("score"), F.col("ts").cast("long").alias("ts")).groupBy(by).applyInPandas(lambda g: keep(g), f"{by} {kind}, id long, first long")


#: Words of the smaller side that go to every task; more are dealt out.
SENT_WORDS = 2_000_000


def similar_pairs(left: DataFrame, right: DataFrame, words: Column, threshold: float) -> DataFrame:
    """(l_id, r_id, similarity) of pairs with at least that Jaccard likeness of words; both sides are (id, text).

    Words are put in order of how many texts of the smaller side have them, those of none first; a pair that is alike enough
    shares one of the first few words of each. A text whose first few words are all foreign to the smaller side has no
    partner, and foreign words are never dealt out: of each text only the words of the smaller side go on, beside its size.
    Those tell the likeness exactly, as no other word can be shared.
    """
    sides = left.select(F.lit("l").alias("side"), "id", words.alias("ws")).unionByName(right.select(F.lit("r").alias("side"), "id", words.alias("ws")))
    sets = written(sides.select("side", "id", "ws", F.size("ws").alias("n")).where("n > 0"), "words")  # texts are cut into words once
    rows = {r["side"]: r["c"] for r in sets.groupBy("side").agg(F.count("*").alias("c")).collect()}
    small = min("lr", key=lambda x: rows.get(x, 0))
    often = written(sets.where(F.col("side") == small).select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("c")), "often")
    often = F.broadcast(often) if often.count() <= SENT_WORDS else often
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x["w"])
    known = sets.select("side", "id", "n", F.explode("ws").alias("w")).join(often, "w").groupBy("side", "id", "n").agg(listed.alias("ws"))
    known = written(known, "sets")

    def side(p: str) -> DataFrame:
        return known.where(F.col("side") == p).select(F.col("id").alias(f"{p}_id"), F.col("n").alias(f"{p}_n"), F.col("ws").alias(f"{p}_w"))

    def first_words(p: str) -> DataFrame:
        n = F.col(f"{p}_n")
        few = n - F.ceil(n * threshold) + 1 - (n - F.size(f"{p}_w"))  # less those that are foreign
        return side(p).where(few > 0).select(f"{p}_id", f"{p}_n", F.explode(F.slice(f"{p}_w", F.lit(1), few.cast("int"))).alias("w"))

    near = first_words("l").join(first_words("r"), "w").where((F.col("l_n") >= threshold * F.col("r_n")) & (F.col("r_n") >= threshold * F.col("l_n")))
    full = near.select("l_id", "r_id").distinct().join(side("l"), "l_id").join(side("r"), "r_id")
    shared = F.size(F.array_intersect("l_w", "r_w")).cast("double")
    return full.withColumn("similarity", shared / (F.col("l_n") + F.col("r_n") - shared)).where(F.col("similarity") >= threshold).select("l_id", "r_id", "similarity")


def exact_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hash, n, first_id of texts that occur more than once."""
    g = docs.where(F.col(text_col).isNotNull()).groupBy(T.content_hash(F.col(text_col)).alias("hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    return g.where("n > 1")


def reduction(before: Column, after: Column) -> Column:
    """Percent that de-duplication took away."""
    return F.when(before > 0, F.round((before - after) / before * 100, 2)).otherwise(F.lit(0.0))
