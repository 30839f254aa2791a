"""Conversation histories: limits, merges, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "conv_id", "turn"


def last_user_turns(turns: DataFrame, n: int | None) -> DataFrame:
    """Everything from the n-th last user turn on; all if n is none or not positive, or there are fewer."""
    if not n or n <= 0:
        return turns
    w = Window.partitionBy(KEY).orderBy(F.desc(ORDER))
    users = F.sum((F.col("role") == "user").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = turns.withColumn("users", users).withColumn("all_users", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy(KEY)))
    stays = (F.col("users") < n) | ((F.col("users") == n) & (F.col("role") == "user")) | (F.col("all_users") < n)
    return d.where(stays).drop("users", "all_users")


def merged_turns(turns: DataFrame) -> DataFrame:
    """Consecutive turns of one role as one: conv_id, island, role, first_turn, n, text joined by blank lines."""
    w = Window.partitionBy(KEY).orderBy(ORDER)
    new = F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).cast("int")
    d = turns.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct(ORDER, F.coalesce("text", F.lit("")).alias("text"))))
    return d.groupBy(KEY, "island", "role").agg(F.min(ORDER).alias("first_turn"), F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("text"))


def newest_within(turns: DataFrame, size: Column, budget: int) -> DataFrame:
    """The longest run of newest turns whose sizes add up to the budget at most."""
    w = Window.partitionBy(KEY).orderBy(F.desc(ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def newest_bytes(turns: DataFrame, most: int) -> DataFrame:
    """As newest_within() by bytes; if even the last turn is too large, it alone with its text replaced."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    d = turns.withColumn("last", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(ORDER))))
    d = newest_within(d.withColumn("size", size), F.col("size"), most).drop("used").unionByName(d.withColumn("size", size).where((F.col("last") == 1) & (F.col("size") > most)).withColumn("text", F.lit("[omitted: message too large]")))
    return d.drop("last", "size")


def token_parts(turns: DataFrame, tokens: Column, parts: int) -> DataFrame:
    """Turns with `part`: where the tokens before a turn lie among so many equal shares of its conversation's."""
    w = Window.partitionBy(KEY).orderBy(ORDER)
    d = turns.withColumn("t", tokens).withColumn("before", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("t").over(Window.partitionBy(KEY)))
    return d.withColumn("part", F.least(F.lit(parts - 1), F.floor(F.when(F.col("all") > 0, F.col("before") * parts / F.col("all")).otherwise(0)).cast("int"))).drop("t", "before", "all")


def pruned_results(turns: DataFrame, role: str, keep_last: int = 3, most: int = 4000, head: int = 1500, tail: int = 1500) -> DataFrame:
    """Long texts of a role that stand before the last `keep_last` assistant turns, with their middle left out."""
    w = Window.partitionBy(KEY).orderBy(F.desc(ORDER)).rowsBetween(Window.unboundedPreceding, 0)
    old = F.sum((F.col("role") == "assistant").cast("int")).over(w) >= keep_last
    short = F.concat(F.left("text", F.lit(head)), F.lit("\n...\n"), F.right("text", F.lit(tail)))
    return turns.withColumn("old", old).withColumn("text", F.when(F.col("old") & (F.col("role") == role) & (F.length("text") > most), short).otherwise(F.col("text"))).drop("old")


def without_orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call is still there."""
    return results.join(calls.select("call_id").distinct(), "call_id", "left_semi")


def answered_calls(turns: DataFrame) -> DataFrame:
    """Assistant turns' call ids that the next turn, a user's, answers; turns has arrays `calls` and `answers`."""
    w = Window.partitionBy(KEY).orderBy(ORDER)
    answers = F.when(F.lead("role").over(w) == "user", F.lead("answers").over(w))
    return turns.withColumn("given", F.coalesce(answers, F.array().cast("array<string>"))).withColumn("calls", F.array_intersect("calls", "given")).drop("given")


def first_of_each(rows: DataFrame, value: str, order: str) -> DataFrame:
    """The first row of each value that is not null, by `order`. Only a hash of the value is grouped, so wide values move once."""
    keyed = rows.where(F.col(value).isNotNull()).withColumn("hash", F.sha2(F.col(value).cast("string"), 256))
    first = keyed.groupBy("hash").agg(F.min(order).alias(order))
    return keyed.join(first, ["hash", order], "left_semi").dropDuplicates(["hash"]).drop("hash")
