"""Bounded caches over streams that are stopped and started again, against lists."""

import random

import pytest

from larkspur.streaming import caches

MINUTE = 60_000


def brute(batches, ttl, most, kept=None):
    """Every namespace's cache and record as lists of [key, ts], the oldest first."""
    memory, record, clock, out = {}, {}, {}, []
    for events in batches:
        for ns, key, ts, item in sorted(events, key=lambda e: (e[2], e[3])):
            ns = ns or "global"
            m, r = memory.setdefault(ns, []), record.setdefault(ns, [])
            now = clock[ns] = max(clock.get(ns, 0), ts)
            hit, gone = False, []
            if key:
                hit = any(k == key and (not ttl or now - t < ttl) for k, t in m)
                m[:] = [x for x in m if x[0] != key] + [[key, now]]
                if not hit:
                    left = [x for x in m if not ttl or now - x[1] <= ttl]
                    left = left[max(0, len(left) - most) :]
                    gone, m[:] = [k for k, _ in m if k not in [y for y, _ in left]], left
                if kept is not None and not hit:
                    gone = []
                    hit = any(k == key and (not ttl or now - t < ttl) for k, t in r)
                    if not hit:
                        rest = [x for x in r if x[0] != key] + [[key, now]]
                        left = [x for x in rest if not ttl or now - x[1] < ttl]
                        left = left[max(0, len(left) - kept) :]
                        gone, r[:] = [k for k, _ in rest if k not in [y for y, _ in left]], left
            out.append((ns, key, ts, item, hit, len(m if kept is None else r), gone))
    return sorted(out, key=str)


def events(n, seed, start=0):
    rng, ts = random.Random(seed), start
    rows = []
    for i in range(n):
        ts += rng.randrange(3 * MINUTE)
        rows.append((rng.choice(["a", "b", None]), rng.choice([*"pqrstuvwxyz", "", None]), ts, f"{seed}-{i:03d}"))
    return rows


@pytest.mark.parametrize(("ttl", "most", "kept"), [(20 * MINUTE, 4, None), (0, 3, None), (15 * MINUTE, 2, 6), (0, 1, 5), (10 * MINUTE, 0, None)])
def test_state_survives_a_restart_and_the_oldest_goes(spark, tmp_path, ttl, most, kept):
    batches = [events(60, 1), events(50, 2, 60 * 3 * MINUTE), events(40, 3, 110 * 3 * MINUTE)]
    schema = "namespace string, key string, ms long, item string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").selectExpr("namespace", "key", "timestamp_millis(ms) AS time", "item")
        out = caches.deduplicated(source, "namespace", "key", "time", "item", ttl, most, kept, delay="1 day")
        with caches.rocksdb(spark):  # a query of its own for each batch: what it knows is in the checkpoint
            out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
        assert spark.read.schema(out.schema).parquet(f"{tmp_path}/out").count() == sum(map(len, batches[: k + 1]))
    got = sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == brute(batches, ttl, most, kept)


def test_the_sessions_own_state_store_comes_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with caches.rocksdb(spark):
        assert spark.conf.get(name) == caches.ROCKSDB
    assert spark.conf.get(name) == before


class Counted:
    """A map or value state that counts how often it is called."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _called(self):
        self.calls += 1
        return self.rows

    def containsKey(self, key):  # noqa: N802
        return key in self._called()

    def getValue(self, key):  # noqa: N802
        return self._called()[key]

    def updateValue(self, key, value):  # noqa: N802
        self._called()[key] = value

    def removeKey(self, key):  # noqa: N802
        self._called().pop(key, None)

    def iterator(self):
        return iter(list(self._called().items()))

    def exists(self):
        return () in self._called()

    def get(self):
        return self._called()[()]

    def update(self, value):
        self._called()[()] = value


def driven(batches, ttl, most):
    """What a namespace's cache tells of batches, and how often its states are called."""
    states, out = [Counted(), Counted(), Counted()], []
    for rows in batches:
        lru = caches.Lru(caches._Map(states[0], False), caches._Map(states[1], True), caches._Value(states[2]), ttl, most)
        lru.load()
        for _, key, ts, item in sorted(rows, key=lambda e: (e[2], e[3])):
            hit, gone = lru.check(key, ts)
            out.append(("a", key, ts, item, hit, lru.size(), gone))
            if lru.at_hand() > 2 * caches.HELD:
                lru.write()
        lru.write()
        assert all(len(s.rows) == lru.size() for s in states[:2])
    return sorted(out, key=str), sum(s.calls for s in states)


def keyed(n, seed, start, keys):
    rng = random.Random(seed)
    return [("a", f"k{rng.randrange(keys)}", start + i * MINUTE, f"{seed}-{i:05d}") for i in range(n)]


def test_a_batch_calls_its_state_by_entries_and_not_by_events():
    batches = [keyed(3000, 1, 0, 40), keyed(3000, 2, 3000 * MINUTE, 40)]
    got, calls = driven(batches, 30 * MINUTE, 25)
    assert got == brute(batches, 30 * MINUTE, 25)
    assert calls < 400  # several for each of 6000 events, if every event asked the state


@pytest.mark.parametrize("held", [0, 1, 5, 12])
def test_a_cache_that_is_not_kept_at_hand(monkeypatch, held):
    monkeypatch.setattr(caches, "HELD", held)
    batches = [keyed(300, k, k * 300 * MINUTE, 30) for k in range(3)]
    for ttl, most in ((0, 10), (15 * MINUTE, 20), (40 * MINUTE, 4)):
        assert driven(batches, ttl, most)[0] == brute(batches, ttl, most)
