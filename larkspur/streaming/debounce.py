"""Debouncing by the item: each has a gap of its own, some are not to wait at all, and what waited goes out in one batch.

An item that may wait starts or prolongs its key's buffer, which goes out when the last item's gap has passed without another.
So a short gap after a long one shortens the wait; a window that adds up the gaps of all its items would not do that. An item
that may not wait lets the buffer go first and then goes alone, as does one without a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkspur.streaming.batch import micros

OUT = "key string, start long, last long, items array<string>, flushed_at long, reason string"


def _prepared(events: DataFrame, key: str, ts: str, item: str, gap_ms: Column, waits: Column | None) -> DataFrame:
    """key, ts (milliseconds), item, gap; a gap of 0 for what may not wait."""
    waits = F.lit(True) if waits is None else waits
    gap = F.when(waits & F.col(key).isNotNull() & (F.col(key).cast("string") != ""), F.greatest(F.lit(0), F.coalesce(gap_ms, F.lit(0)).cast("long")))
    return events.select(F.col(key).cast("string").alias("key"), F.floor(micros(ts) / 1000).cast("long").alias("ts"), F.col(item).cast("string").alias("item"), F.coalesce(gap, F.lit(0)).cast("long").alias("gap")).where("ts is not null")


def batches(events: DataFrame, key: str, ts: str, item: str, gap_ms: Column, waits: Column | None = None) -> DataFrame:
    """key, start, last, items, flushed_at, reason of what goes out together, from a table at rest, in order of time and item.

    reason: `gap` where the last item's gap has passed, `flush` where an item that may not wait came before that, `alone`
    for one of those. Items of null and empty keys, null or negative gaps and a null or false `waits` go alone; null times
    are left out.
    """
    d = _prepared(events, key, ts, item, gap_ms, waits)
    w = Window.partitionBy("key").orderBy("ts", "item")
    before = F.lag("ts").over(w) + F.lag("gap").over(w)
    new = (F.col("gap") == 0) | F.coalesce(F.lag("gap").over(w) == 0, F.lit(True)) | (F.col("ts") >= before)
    d = d.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # what comes next, if it may not wait
    d = d.withColumn("next_alone", F.when(F.lead("gap").over(w) == 0, F.lead("ts").over(w)))
    tail = F.max_by(F.struct("ts", "gap", "next_alone"), F.struct("ts", "item"))
    g = d.groupBy("key", "island").agg(F.min("ts").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "item"))), lambda x: x["item"]).alias("items"), tail.alias("t"))
    due = F.col("t.ts") + F.col("t.gap")
    early = F.coalesce(F.col("t.next_alone") < due, F.lit(False))
    reason = F.when(F.col("t.gap") == 0, "alone").when(early, "flush").otherwise("gap")
    return g.select("key", "start", F.col("t.ts").alias("last"), "items", F.when(early, F.col("t.next_alone")).otherwise(due).alias("flushed_at"), reason.alias("reason"))


#: Groups of keys that share a state. A stream's checkpoint holds on to it.
BUCKETS = 1024


def advance(waiting: list[tuple], buffer: list[tuple], now: int) -> tuple[list[tuple], list[tuple]]:
    """What goes out of a key up to now (start, last, items, flushed_at, reason), and the items that wait on; buffer is changed."""
    out = []

    def flush(at: int, reason: str) -> None:
        out.append((buffer[0][0], buffer[-1][0], [x[1] for x in buffer], at, reason))
        buffer.clear()

    def due() -> int:
        return buffer[-1][0] + buffer[-1][2]

    waiting = sorted(waiting)
    for ts, item, gap in [x for x in waiting if x[0] <= now]:
        if buffer and ts >= due():
            flush(due(), "gap")
        if gap == 0:
            if buffer:
                flush(ts, "flush")
            buffer.append((ts, item, gap))
            flush(ts, "alone")
        else:
            buffer.append((ts, item, gap))
    if buffer and due() <= now:
        flush(due(), "gap")
    return out, [x for x in waiting if x[0] > now]


class Debounce(StatefulProcessor):
    """A key's items wait until the watermark has passed them, so that they are taken in order of time whenever they came.

    Keys share BUCKETS groups by their hash, as a group costs Spark and pandas milliseconds however few items it has. Each key has
    an entry of its own in its bucket's state; the bucket wakes when the first of its keys has something to do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getMapState("waits", "key string", "pending array<struct<ts: long, item: string, gap: long>>, buffer array<struct<ts: long, item: string, gap: long>>, wake long")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[str, list[tuple]] = {}
        for d in rows:
            for k, *x in zip(d["key"].tolist(), d["ts"].tolist(), d["item"].tolist(), d["gap"].tolist(), strict=True):
                new.setdefault(k, []).append(tuple(x))
        for k, items in new.items():
            pending, buffer, wake = self.waits.getValue((k,)) if self.waits.containsKey((k,)) else ([], [], None)
            first = min(t for t, _, _ in items)
            self.waits.updateValue((k,), ([tuple(x) for x in pending] + items, [tuple(x) for x in buffer], first if wake is None else min(wake, first)))
        self._wake(min(t for items in new.values() for t, _, _ in items))
        yield from self._none()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs()
        out, nexts = [], []
        for (k,), (pending, buffer, wake) in list(self.waits.iterator()):
            if wake <= now:
                buffer = [tuple(x) for x in buffer]
                gone, later = advance([tuple(x) for x in pending], buffer, now)
                out += [(k, *x) for x in gone]
                wake = min([*([later[0][0]] if later else []), *([buffer[-1][0] + buffer[-1][2]] if buffer else [])], default=None)
                if wake is None:
                    self.waits.removeKey((k,))
                    continue
                self.waits.updateValue((k,), (later, buffer, wake))
            nexts.append(wake)
        if nexts:
            self._wake(min(nexts))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        else:
            yield from self._none()

    def _wake(self, at: int) -> None:
        if self.timer.exists():
            (before,) = self.timer.get()
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    @staticmethod
    def _none() -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({c.split()[0]: pd.Series(dtype="object") for c in OUT.split(", ")})

    def close(self) -> None:
        pass


def stream(events: DataFrame, key: str, ts: str, item: str, gap_ms: Column, waits: Column | None = None, delay: str = "10 minutes") -> DataFrame:
    """batches() of a stream: each goes out once the watermark has passed its flushed_at. Items that come later than `delay` may
    allow start a buffer of their own. Start it inside caches.rocksdb()."""
    d = _prepared(events, key, ts, item, gap_ms, waits).withColumn("time", F.timestamp_millis("ts")).withWatermark("time", delay)
    d = d.withColumn("key", F.coalesce("key", F.lit("")))  # what has no key goes alone under an empty one
    d = d.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return d.groupBy("bucket").transformWithStateInPandas(Debounce(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def flushed_to(path: str, made: Callable[[DataFrame], DataFrame] = lambda d: d) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that writes made(batch) below path, in a folder of the batch's own.

    A batch that comes again, as it does when a stream stops between writing and its checkpoint, takes the place of what it
    wrote before, whole or not; so readers of the path get everything once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
