"""The same operators on streams, exact, with keyed state.

Each has a step - a plain function of state and event, which tests drive by hand - and a stream that applies it with
applyInPandasWithState. Events of a key are taken in order of time within a batch; state that has outlived its time goes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

State = dict
#: Groups of keys that share a state. A stream's checkpoint holds on to it.
BUCKETS = 1024


def ttl_step(ttl_ms: int) -> Callable[[State, int, str], dict]:
    """is_duplicate: whether the key was seen less than ttl before; a hit renews it."""

    def step(s: State, ts: int, item: str) -> dict:
        seen = s.get("ts")
        s["ts"] = ts
        return {"is_duplicate": seen is not None and ts - seen < ttl_ms}

    return step


def persistent_step(ttl_ms: int) -> Callable[[State, int, str], dict]:
    """is_new: whether the key was not recorded less than ttl before (ever, for none). Only what is new is recorded."""

    def step(s: State, ts: int, item: str) -> dict:
        if "at" in s and (ttl_ms <= 0 or ts - s["at"] < ttl_ms):
            return {"is_new": False}
        s["at"] = ts
        return {"is_new": True}

    return step


def fixed_window_step(most: int, window_ms: int) -> Callable[[State, int, str], dict]:
    """allowed, remaining, retry_after: a window begins with the first event after the one before has ended."""

    def step(s: State, ts: int, item: str) -> dict:
        if "start" not in s or ts - s["start"] >= window_ms:
            s["start"], s["n"] = ts, 0
        if s["n"] >= most:
            return {"allowed": False, "remaining": 0, "retry_after": max(0, s["start"] + window_ms - ts)}
        s["n"] += 1
        return {"allowed": True, "remaining": most - s["n"], "retry_after": 0}

    return step


def lockout_step(most: int, window_ms: int, lockout_ms: int) -> Callable[[State, int, str], dict]:
    """allowed, remaining, retry_after of failures (item `failure`), checks (`check`) and successes (`reset`)."""

    def step(s: State, ts: int, item: str) -> dict:
        if s.get("until", 0) and ts >= s["until"]:
            s["until"], s["log"] = 0, []
        if s.get("until", 0):
            return {"allowed": False, "remaining": 0, "retry_after": s["until"] - ts}
        log = [t for t in s.get("log", []) if t > ts - window_ms]
        if item == "reset":
            log = []
        elif item == "failure":
            log.append(ts)
            if len(log) >= most:
                s["until"] = ts + lockout_ms
        s["log"] = log
        left = max(0, most - len(log))
        return {"allowed": not s.get("until", 0), "remaining": left, "retry_after": s["until"] - ts if s.get("until", 0) else 0}

    return step


def queue_step(cap: int, policy: str) -> Callable[[State, int, str], dict]:
    """queued, size, dropped: beyond the cap `new` refuses, `old` and `summarize` let the oldest go; equal items once."""

    def step(s: State, ts: int, item: str) -> dict:
        items = s.setdefault("items", [])
        queued = item not in items
        if queued and len(items) >= cap:
            if policy == "new":
                queued = False
            else:
                items.pop(0)
                s["dropped"] = s.get("dropped", 0) + (policy == "summarize")
        if queued:
            items.append(item)
        return {"queued": queued, "size": len(items), "dropped": s.get("dropped", 0)}

    return step


def bucket_run(step: Callable[[State, int, str], dict], names: list[str], idle_ms: int) -> Callable:
    """What applied() does with a bucket of keys; its state is a list of key, time to be forgotten at, state of the key."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {key: [until, s] for key, until, s in json.loads(state.get[0])} if state.exists else {}
        now, rows = state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            g = pd.concat(list(batches)).sort_values(["time", "item"], kind="stable")
            ms = g["time"].astype("int64") // (10**6 if g["time"].dtype == "datetime64[ns]" else 10**3)
            for key, t, x in zip(g["key"].tolist(), ms.tolist(), g["item"].tolist(), strict=True):
                mine = held.setdefault(key, [0, {}])
                told = step(mine[1], t, x)
                mine[0] = max(now, t) + idle_ms
                rows.append([key, t, x, *[told[n] for n in names]])
        kept = [[key, until, s] for key, (until, s) in held.items() if until >= now]
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(min(until for _, until, _ in kept))
        elif state.exists:
            state.remove()
        if rows:
            yield pd.DataFrame(rows, columns=["key", "ts", "item", *names])

    return run


def applied(stream: DataFrame, key: str, ts: str, item: str, step: Callable[[State, int, str], dict], out: str, idle_ms: int, delay: str = "10 minutes") -> DataFrame:
    """key, ts (milliseconds), item and what the step tells, for every event of a stream; idle keys are forgotten.

    Keys share BUCKETS groups by their hash, as a group costs Spark and pandas milliseconds however few events it has; each
    key has a state of its own in its bucket's.
    """
    typed = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("time"), F.col(item).cast("string").alias("item"))
    typed = typed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    run = bucket_run(step, [x.split()[0] for x in out.split(", ")], idle_ms)
    return typed.withWatermark("time", delay).groupBy("bucket").applyInPandasWithState(run, f"key string, ts long, item string, {out}", "state string", "append", "EventTimeTimeout")


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay. A hit does not renew the time; see ttl_step for that."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def session_runs(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Runs of events less than a gap apart, each once the watermark has passed it."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return s.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(stream: DataFrame, key: str, ts: str, size: str, delay: str) -> DataFrame:
    """Events by key in windows of the clock."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return s.groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")
