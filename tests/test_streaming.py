"""Steps driven by hand, and the streams against the same in batch."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.plans.registry import Tables
from larkspur.plans.stream_queries import ran
from larkspur.streaming import batch, stateful

SF = "/root/testdata/sf0.001"


def drive(step, *events):
    s = {}
    return [step(s, *e) for e in events]


def test_ttl_is_renewed_by_hits():
    got = drive(stateful.ttl_step(1000), (100, "a"), (900, "a"), (1800, "a"), (2800, "a"))
    assert [g["is_duplicate"] for g in got] == [False, True, True, False]


def test_fixed_window():
    got = drive(stateful.fixed_window_step(2, 1000), (1000, ""), (1000, ""), (1000, ""), (2000, ""))
    assert [(g["allowed"], g["remaining"], g["retry_after"]) for g in got] == [(True, 1, 0), (True, 0, 0), (False, 0, 1000), (True, 1, 0)]


def test_lockout():
    step = stateful.lockout_step(2, 1000, 5000)
    got = drive(step, (0, "failure"), (1500, "failure"), (1600, "failure"), (2000, "check"), (6600, "check"), (6700, "failure"), (6800, "reset"), (6900, "check"))
    assert [g["allowed"] for g in got] == [True, True, False, False, True, True, True, True]
    assert [g["remaining"] for g in got] == [1, 1, 0, 0, 2, 1, 2, 2]


@pytest.mark.parametrize(("policy", "queued", "sizes", "dropped"), [("new", [1, 1, 0, 0], [1, 2, 2, 2], 0), ("old", [1, 1, 0, 1], [1, 2, 2, 2], 0), ("summarize", [1, 1, 0, 1], [1, 2, 2, 2], 1)])
def test_queue(policy, queued, sizes, dropped):
    got = drive(stateful.queue_step(2, policy), (1, "a"), (2, "b"), (3, "b"), (4, "c"))
    assert [int(g["queued"]) for g in got] == queued and [g["size"] for g in got] == sizes and got[-1]["dropped"] == dropped


def test_stream_of_ttl_agrees_with_batch(spark):
    t = Tables(spark, SF)
    e = t.events.withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    stream = ran(t, "ttl_test", lambda s: stateful.applied(s.withColumn("key", F.concat_ws(":", "user_id", "event_type")), "key", "ts", "event_id", stateful.ttl_step(6 * 3_600_000), "is_duplicate boolean", 12 * 3_600_000))
    got = {int(r.item): r.is_duplicate for r in stream.collect()}
    # the stream counts in milliseconds
    want = {r.event_id: r.is_duplicate for r in batch.ttl_duplicates(e.withColumn("ts", F.date_trunc("MILLISECOND", "ts")), "key", "ts", "event_id", 6 * 3_600_000).collect()}
    assert got == want


class Bucket:
    """A group's state as applyInPandasWithState has it."""

    def __init__(self):
        self.value, self.timeout, self.now, self.hasTimedOut = None, None, 0, False

    exists = property(lambda s: s.value is not None)
    get = property(lambda s: s.value)

    def getCurrentWatermarkMs(self):  # noqa: N802
        return self.now

    def setTimeoutTimestamp(self, at):  # noqa: N802
        assert at >= self.now
        self.timeout = at

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None


def test_keys_of_a_bucket_have_states_and_ends_of_their_own():
    run, state = stateful.bucket_run(stateful.ttl_step(1000), ["is_duplicate"], 5000), Bucket()

    def sent(now, *rows, timed_out=False):
        state.now, state.hasTimedOut = now, timed_out
        d = pd.DataFrame(rows, columns=["key", "time", "item"])
        d["time"] = pd.to_datetime(d["time"], unit="ms")
        return [tuple(r) for x in run((0,), iter([d]), state) for r in x.itertuples(index=False)]

    assert sent(0, ("b", 500, "3"), ("a", 100, "1"), (None, 100, "2"), ("a", 900, "4"), ("null", 900, "5")) == [("a", 100, "1", False), (None, 100, "2", False), ("b", 500, "3", False), ("a", 900, "4", True), ("null", 900, "5", False)]
    assert state.timeout == 5100  # the null key's
    assert sent(1000, ("a", 1800, "6"), ("b", 1800, "7")) == [("a", 1800, "6", True), ("b", 1800, "7", False)]
    assert sent(5200, timed_out=True) == [] and [x[0] for x in json.loads(state.value[0])] == ["a", "b", "null"] and state.timeout == 5900
    assert sent(6801, timed_out=True) == [] and not state.exists


def test_many_keys_are_few_groups(spark, monkeypatch):
    """As many groups as buckets, not as keys: a step sees what others of its bucket have left in the process."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    t, groups = Tables(spark, SF), spark.sparkContext.accumulator(0)
    made = stateful.bucket_run

    def counted(*args):
        run = made(*args)

        def one(k, batches, state):
            groups.add(1)
            yield from run(k, batches, state)

        return one

    monkeypatch.setattr(stateful, "bucket_run", counted)
    out = ran(t, "few_groups", lambda s: stateful.applied(s, "event_id", "ts", "event_type", stateful.ttl_step(1000), "is_duplicate boolean", 10**12))
    assert out.where("not is_duplicate").count() == t.events.count() > 100 and groups.value <= 4


def test_debounce_with_a_control_event(spark):
    rows = [(1, "k", 0, False), (2, "k", 1, False), (3, "k", 1, True), (4, "k", 2, False), (5, "k", 20, False)]
    d = spark.createDataFrame(rows, "id int, key string, s int, control boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = batch.debounced_with_control(d, "key", "ts", "id", 10_000, F.col("control")).orderBy("batch").collect()
    assert [(r.n, r.is_control) for r in got] == [(2, False), (1, True), (1, False), (1, False)]
