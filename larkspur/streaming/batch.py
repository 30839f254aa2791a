"""Operators on inbound events over tables at rest: what state does in a stream, windows do here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import time as tm
from larkspur.operators.retrieval import pieces


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def ttl_duplicates(events: DataFrame, key: str, ts: str, order: str, ttl_ms: int) -> DataFrame:
    """events with `is_duplicate`: whether one of the same key came less than ttl before; every hit renews the time."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = micros(ts) - F.lag(micros(ts)).over(w)
    return events.withColumn("is_duplicate", F.coalesce(gap < ttl_ms * 1000, F.lit(False)))


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, end, n: runs of events less than a gap apart."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.max(ts).alias("end")).select(key, F.col("w.start").alias("start"), "end", "n")


def debounced_with_control(events: DataFrame, key: str, ts: str, order: str, gap_ms: int, control: Column) -> DataFrame:
    """key, batch, start, n, is_control: runs less than a gap apart; a control event ends the run before it and is one of its own."""
    w = Window.partitionBy(key).orderBy(ts, order)
    d = events.withColumn("c", control)
    new = F.coalesce(micros(ts) - F.lag(micros(ts)).over(w) >= gap_ms * 1000, F.lit(True)) | F.col("c") | F.coalesce(F.lag("c").over(w), F.lit(False))
    d = d.withColumn("new", new.cast("int")).withColumn("batch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "batch").agg(F.min(ts).alias("start"), F.count("*").alias("n"), F.max("c").alias("is_control"))


def aligned_limit(events: DataFrame, key: str, ts: str, order: str, most: int, window_s: int) -> DataFrame:
    """events with `allowed`: whether it is among the first `most` of its key in its window of the clock."""
    d = events.withColumn("slot", F.floor(micros(ts) / (window_s * 1_000_000)))
    w = Window.partitionBy(key, "slot").orderBy(ts, order)
    return d.withColumn("allowed", F.row_number().over(w) <= most).drop("slot")


def sliding_counts(events: DataFrame, key: str, ts: str, window_s: int, most: int) -> DataFrame:
    """events with `recent` (of its key in the window up to it, itself included) and `over` (more than `most`)."""
    d = events.withColumn("us", micros(ts))
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-window_s * 1_000_000, 0)
    return d.withColumn("recent", F.count("*").over(w)).withColumn("over", F.col("recent") > most).drop("us")


def repeats(events: DataFrame, key: str, ts: str, order: str, what: str, last: int = 30) -> DataFrame:
    """events with `seen` (the same among the last so many of its key, itself included) and `run` (in a row up to it)."""
    w = Window.partitionBy(key).orderBy(ts, order)
    d = events.withColumn("recent", F.collect_list(what).over(w.rowsBetween(-last + 1, 0)))
    d = d.withColumn("seen", F.size(F.filter("recent", lambda x: x == F.col(what)))).drop("recent")
    d = d.withColumn("new", F.coalesce(F.lag(what).over(w) != F.col(what), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn("run", F.row_number().over(Window.partitionBy(key, "island").orderBy(ts, order))).drop("new", "island")


# Calls that are looked back at, and how many make a warning, a block, and the end whatever the tool.
HISTORY, WARNING, CRITICAL, BREAKER = 30, 10, 20, 30


def loops(calls: DataFrame, key: str, ts: str, order: str, tool: str, params: str, result: str, polls: list[str], longest: int = 5, history: int = HISTORY, warning: int = WARNING, critical: int = CRITICAL, breaker: int = BREAKER) -> DataFrame:
    """calls with `repeats`, `still`, `period`, `cycle`, `level` and `detector`: whether a call goes round in circles.

    All figures are of the last `history` calls of the key, the call itself included, equal times in order of `order`:

    * repeats: calls of the same tool with the same params.
    * still: calls in a row up to this one with the same tool, params and result.
    * cycle: how many calls in a row up to this one repeat what was `period` calls before, result and all, and the first
      `period` with them, for the period (2 to `longest`) with most of them, the least of several; 0 without two whole
      periods, and where `still` reaches as far back.

    Detectors, and from where on each warns or blocks (level `warning` or `critical`): `breaker` blocks from still >= breaker on;
    `poll` (tools in polls, by still), `ping_pong` (period 2) and `cycle` (longer ones), and `repeat` from warning and
    critical on. The highest level tells, and of detectors with that level the first of these. Null without any. A null tool,
    params or result equals another null.

    A run is told by the last call that breaks it, so every figure is a window over scalars, all by one sort.
    """
    w = Window.partitionBy(key).orderBy(ts, order)
    d = calls.withColumn("_n", F.row_number().over(w)).withColumn("_call", F.xxhash64(tool, params)).withColumn("_all", F.xxhash64(tool, params, result))
    nulls = lambda *cols: F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    d = d.withColumns({"_call": F.struct("_call", nulls(tool, params)), "_all": F.struct("_all", nulls(tool, params, result))})

    def run(p: int) -> Column:
        """Calls in a row up to this one that equal the one p before, of those that lie in the history."""
        broken = F.when(~F.coalesce(F.col("_all") == F.lag("_all", p).over(w), F.lit(False)), F.col("_n"))
        return broken, F.coalesce(F.max(f"_b{p}").over(w.rowsBetween(-max(history - 1 - p, 0), 0)), F.greatest(F.col("_n") - (history - p), F.lit(0)))

    for p in range(1, longest + 1):
        d = d.withColumn(f"_b{p}", run(p)[0])
    for p in range(1, longest + 1):
        d = d.withColumn(f"_m{p}", F.col("_n") - run(p)[1])
    # calls of one kind that lie in the history: by their places, which a call knows of its own kind
    kind = Window.partitionBy(key, "_call").orderBy("_n").rangeBetween(-(history - 1), 0)
    d = d.withColumn("repeats", F.count("*").over(kind).cast("int")).withColumn("still", (F.col("_m1") + 1).cast("int"))
    cycles = [F.when(F.col(f"_m{p}") >= p, F.struct((F.col(f"_m{p}") + p).alias("cycle"), F.lit(-p).alias("period"))) for p in range(2, longest + 1)]
    none = F.struct(F.lit(0).alias("cycle"), F.lit(0).alias("period"))
    d = d.withColumn("_c", F.greatest(none, *cycles) if cycles else none)
    real = F.col("_c.cycle") > F.col("still")
    d = d.withColumns({"cycle": F.when(real, F.col("_c.cycle")).otherwise(0).cast("int"), "period": F.when(real, -F.col("_c.period")).otherwise(0).cast("int")})
    by = [("breaker", F.when(F.col("still") >= breaker, 2)), ("poll", _level(F.when(F.col(tool).isin(polls), F.col("still")), warning, critical)), ("ping_pong", _level(F.when(F.col("period") == 2, F.col("cycle")), warning, critical)),
          ("cycle", _level(F.when(F.col("period") > 2, F.col("cycle")), warning, critical)), ("repeat", _level(F.col("repeats"), warning, critical))]
    level = F.greatest(F.lit(0), *[F.coalesce(x, F.lit(0)) for _, x in by])
    d = d.withColumn("_level", level)
    told = F.coalesce(*[F.when((F.col("_level") > 0) & (x == F.col("_level")), F.lit(n)) for n, x in by])
    return d.withColumns({"level": F.when(F.col("_level") == 2, "critical").when(F.col("_level") == 1, "warning"), "detector": told}).drop("_n", "_call", "_all", "_c", "_level", *[f"_{x}{p}" for x in "bm" for p in range(1, longest + 1)])


def _level(n: Column, warning: int, critical: int) -> Column:
    return F.when(n >= critical, 2).when(n >= warning, 1)


def kept_entries(entries: DataFrame, ts: str, order: str, most: int) -> DataFrame:
    """The latest entries, so many at most."""
    return entries.orderBy(F.desc(ts), F.desc(order)).limit(most)


def within_budget(files: DataFrame, size: str, age: str, referenced: DataFrame, id_col: str, budget: int, by: str) -> DataFrame:
    """Files to remove so that each store's total comes down to its budget: the oldest that nothing refers to."""
    total = files.groupBy(by).agg(F.sum(size).alias("all"))
    free = files.join(referenced, id_col, "left_anti").join(total, by).withColumn("piece", F.pmod(F.xxhash64(id_col), F.lit(pieces(files))))

    def removed(d: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(age, id_col).rowsBetween(Window.unboundedPreceding, -1)
        return d.withColumn("freed", F.coalesce(F.sum(size).over(w), F.lit(0))).where(F.col("all") - F.col("freed") > budget).drop("freed")

    # what stays in a piece of its store stays in the store, so one task gets few files of a large store
    return removed(removed(free, by, "piece"), by).drop("all", "piece")


def batch_routes(events: DataFrame, key: str, ts: str, gap: str, route: str) -> DataFrame:
    """Runs as in debounced() with `merge`: whether all events of a run go the same way and can be one."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.countDistinct(route).alias("routes")).select(key, F.col("w.start").alias("start"), "n", (F.col("routes") <= 1).alias("merge"))


def evicted(records: DataFrame, now_ms: int, ttl_ms: int, most: int) -> DataFrame:
    """Records (namespace, key, ts in milliseconds) without those that have outlived ttl, the newest `most` of each namespace."""
    live = records.where(F.lit(now_ms) - F.col("ts") < ttl_ms) if ttl_ms > 0 else records
    w = Window.partitionBy("namespace").orderBy(F.desc("ts"), F.desc("key"))
    return live.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def session_starts(events: DataFrame, key: str, ts: str, order: str, idle_minutes: int | None, at_hour: int | None) -> DataFrame:
    """Events that begin a session of their key, and why: see time.boundary()."""
    w = Window.partitionBy(key).orderBy(ts, order)
    return events.withColumn("why", tm.boundary(F.col(ts), F.lag(ts).over(w), idle_minutes, at_hour)).where("why is not null")
