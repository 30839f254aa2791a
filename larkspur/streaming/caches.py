"""Caches of a bounded size over streams: what was seen not long ago, the least recently used going first.

State is kept by Spark in RocksDB, entry by entry: `seen` maps a key to when it was last touched and to its number, `order` maps
numbers to keys, and `marks` knows the first and the next number, how many entries there are, and the latest time. To let the
oldest go is to follow the numbers from the first one that is still there, so an event costs a few look-ups however large
the cache is. Within a batch, entries are kept at hand and what has changed is written at its end, so what comes and goes in
between never reaches the state, and a cache of up to HELD entries is read once a batch; a larger one is asked entry by entry,
and what has changed is written whenever more than HELD entries are at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "namespace string, key string, ts long, item string, is_duplicate boolean, size int, gone array<string>"
#: Entries of a map state that a task keeps at hand, and rows that it puts out at a time.
HELD, ROWS = 65_536, 10_000
EVENTS = pa.schema([("ts", pa.int64()), ("key", pa.large_string()), ("item", pa.large_string())])


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Inside, streams that are started keep their state in RocksDB, which these caches need; then the session's own choice again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Lru:
    """A cache of `most` entries (none for 0) that live for ttl milliseconds (for ever for 0) on map-like states.

    A hit makes an entry the youngest and renews its time, if `renews`. Whether an entry as old as ttl is let go when room
    is made is a matter of `sharp`; it is no hit in any case.
    """

    def __init__(self, seen, order, marks, ttl: int, most: int, renews: bool = True, sharp: bool = False):
        self.seen, self.order, self.marks, self.ttl, self.most, self.renews, self.sharp = seen, order, marks, ttl, most, renews, sharp

    def check(self, key: str, now: int) -> tuple[bool, list[str]]:
        """Whether the key is there; if not, it is now. And which keys have gone for it."""
        first, following, size = self.marks.get() or (0, 0, 0)
        held = self.seen.get(key)
        hit = held is not None and (self.ttl <= 0 or now - held[0] < self.ttl)
        if hit and not self.renews:
            return True, []
        if held is not None:
            self.order.remove(held[1])
            size -= 1
        self.seen.put(key, (now, following))
        self.order.put(following, key)
        following, size, gone = following + 1, size + 1, []
        while not hit and size:
            oldest = self.order.get(first)
            if oldest is None:
                first += 1
                continue
            age = now - self.seen.get(oldest)[0]
            old = self.ttl > 0 and (age >= self.ttl if self.sharp else age > self.ttl)
            if not old and size <= self.most:
                break
            self.seen.remove(oldest)
            self.order.remove(first)
            first, size = first + 1, size - 1
            gone.append(oldest)
        self.marks.put((first, following, size))
        return hit, gone

    def size(self) -> int:
        return (self.marks.get() or (0, 0, 0))[2]

    def load(self) -> None:
        if self.size() <= HELD:
            self.seen.load()
            self.order.load()

    def write(self) -> None:
        for s in (self.seen, self.order, self.marks):
            s.write()

    def at_hand(self) -> int:
        return max(len(self.seen.now), len(self.order.now))


class _Map:
    """A map state with values as tuples, one-column values as themselves, as a batch has it: see write().

    `now` has what is at hand, None for what has gone; `stored` those of its keys that the state has. Of a state that is at
    hand `whole`, other keys are not there. A key is put only after it was asked for, or if it never was there.
    """

    def __init__(self, state, single: bool):
        self.state, self.single = state, single
        self._forget()

    def _forget(self) -> None:
        self.now, self.stored, self.changed, self.whole = {}, set(), set(), False

    def load(self) -> None:
        self.now = {k[0]: v[0] if self.single else tuple(v) for k, v in self.state.iterator()}
        self.stored, self.whole = set(self.now), True

    def get(self, key):
        if key in self.now:
            return self.now[key]
        if self.whole or not self.state.containsKey((key,)):
            return None
        value = self.state.getValue((key,))
        self.now[key] = value[0] if self.single else tuple(value)
        self.stored.add(key)
        return self.now[key]

    def put(self, key, value) -> None:
        self.now[key] = value
        self.changed.add(key)

    def remove(self, key) -> None:
        if key in self.now and key not in self.stored:
            del self.now[key]
            self.changed.discard(key)
        elif key in self.now or not self.whole:
            self.now[key] = None
            self.stored.add(key)
            self.changed.add(key)

    def write(self) -> None:
        """Writes what has changed; nothing is at hand then."""
        for key in self.changed:
            value = self.now[key]
            if value is None:
                self.state.removeKey((key,))
            else:
                self.state.updateValue((key,), (value,) if self.single else value)
        self._forget()

    def clear(self) -> None:
        self.state.clear()
        self._forget()


class _Value:
    """A value state, read and written once a batch."""

    def __init__(self, state):
        self.state, self.now = state, None

    def get(self):
        if self.now is None and self.state.exists():
            self.now = tuple(self.state.get())
        return self.now

    def put(self, value) -> None:
        self.now = value

    def write(self) -> None:
        if self.now is not None:
            self.state.update(self.now)
        self.now = None

    def clear(self) -> None:
        self.state.clear()
        self.now = None


def _lru(handle: StatefulProcessorHandle, name: str, **rules) -> tuple[Lru, list]:
    seen = handle.getMapState(f"{name}_seen", "key string", "ts long, number long")
    order = handle.getMapState(f"{name}_order", "number long", "key string")
    marks = handle.getValueState(f"{name}_marks", "first long, following long, size long")
    states = [_Map(seen, False), _Map(order, True), _Value(marks)]
    return Lru(*states, **rules), states


class Dedupe(StatefulProcessor):
    """The events of a namespace against its cache; with `kept`, against a longer-lived record too, which a hit does not renew."""

    def __init__(self, ttl: int, most: int, kept: int | None = None):
        self.ttl, self.most, self.kept = ttl, most, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory, self.states = _lru(handle, "memory", ttl=self.ttl, most=self.most)
        self.record = None
        if self.kept is not None:
            self.record, more = _lru(handle, "record", ttl=self.ttl, most=self.kept, renews=False, sharp=True)
            self.states += more
        self.clock = _Value(handle.getValueState("clock", "now long, timer long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # as Arrow columns, which are a few bytes a value; rows become Python's a few at a time
        d = pa.Table.from_batches([pa.RecordBatch.from_pandas(x[EVENTS.names], EVENTS, preserve_index=False) for x in rows], EVENTS).combine_chunks()
        order = pc.sort_indices(d, sort_keys=[("ts", "ascending"), ("item", "ascending")])
        now, timer = self.clock.get() or (0, 0)
        caches = [c for c in (self.memory, self.record) if c]
        for c in caches:
            c.load()
        for start in range(0, len(order), ROWS):
            part = d.take(order.slice(start, ROWS))
            out = []
            for ts, name, item in zip(*(part[c].to_pylist() for c in EVENTS.names), strict=True):
                now = max(now, ts)  # a namespace's time never goes back
                hit, gone = False, []
                if name:
                    hit, gone = self.memory.check(name, now)
                    if self.record is not None and not hit:
                        hit, gone = self.record.check(name, now)
                out.append((key[0], name, ts, item, hit, caches[-1].size(), gone))
                for c in caches:
                    if c.at_hand() > 2 * HELD:
                        c.write()
            if start + ROWS >= len(order):
                self._end(caches, now, timer)
            yield pd.DataFrame(out, columns=["namespace", "key", "ts", "item", "is_duplicate", "size", "gone"])

    def _end(self, caches: list[Lru], now: int, timer: int) -> None:
        for c in caches:
            c.write()
        if self.ttl > 0:
            if timer:
                self.handle.deleteTimer(timer)
            timer = now + self.ttl + 1
            self.handle.registerTimer(timer)
        self.clock.put((now, timer))
        self.clock.write()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for s in self.states:  # everything has outlived its time
            s.clear()
        self.clock.put((self.clock.get()[0], 0))
        self.clock.write()
        yield pd.DataFrame({c: pd.Series(dtype="object") for c in ["namespace", "key", "ts", "item", "is_duplicate", "size", "gone"]})

    def close(self) -> None:
        pass


def deduplicated(stream: DataFrame, namespace: str, key: str, ts: str, item: str, ttl_ms: int, most: int, kept: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """namespace, key, ts (milliseconds), item, is_duplicate, size, gone: every event of a stream against its namespace's cache.

    An event is a duplicate if its key was touched less than ttl_ms before (ever, for 0) and has not gone since: a new key
    lets those go that have outlived ttl_ms and then, beyond `most` keys, the least recently used. With `kept`, a second
    record of as many keys is asked where the cache has none: it tells whether a key was recorded less than ttl_ms before,
    is not renewed by hits and lets the oldest go; then size and gone are the record's. Events of a namespace are taken in
    order of time and item within a batch, and its time never goes back. Null and empty keys are no duplicates and are not
    kept; events without a time or namespace are left out. A namespace's state goes ttl_ms after its last event.
    Start it inside rocksdb().
    """
    typed = stream.select(F.coalesce(F.col(namespace).cast("string"), F.lit("global")).alias("namespace"), F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("time"), F.col(item).cast("string").alias("item"))
    typed = typed.where("time is not null").withColumn("ts", F.unix_millis("time")).withWatermark("time", delay)
    return typed.groupBy("namespace").transformWithStateInPandas(Dedupe(ttl_ms, most, kept), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
