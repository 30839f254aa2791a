"""Loop detectors against a look back at every call."""

import random

from larkspur.streaming import batch

POLLS = ["poll"]


def brute(calls, longest, history, warning, critical, breaker):
    out = []
    by_key = {}
    for key, ts, tool, params, result in sorted(calls, key=lambda c: (c[1], c[2] or "")):
        seen = by_key.setdefault(key, [])
        seen.append((tool, params, result))
        last = seen[-history:]
        repeats = sum(x[:2] == last[-1][:2] for x in last)

        def run(p, last=last):
            n = 0
            while n + p < len(last) and last[-1 - n] == last[-1 - n - p]:
                n += 1
            return n

        still = run(1) + 1
        cycle, period = max([(run(p) + p, -p) for p in range(2, longest + 1) if run(p) >= p], default=(0, 0))
        cycle, period = (cycle, -period) if cycle > still else (0, 0)
        rank = lambda n: 2 if n >= critical else 1 if n >= warning else 0
        found = [("breaker", 2 if still >= breaker else 0), ("poll", rank(still) if tool in POLLS else 0), ("ping_pong", rank(cycle) if period == 2 else 0), ("cycle", rank(cycle) if period > 2 else 0), ("repeat", rank(repeats))]
        top = max(x for _, x in found)
        out.append((key, ts, repeats, still, period, cycle, [None, "warning", "critical"][top], next((n for n, x in found if x == top), None) if top else None))
    return sorted(out, key=str)


def test_every_detector_against_brute_force(spark):
    rng = random.Random(2)
    calls = []
    for key in range(12):
        ts = 0
        while ts < 150:
            p = rng.randrange(1, 6)
            pattern = [(rng.choice(["poll", "read", "write", None]), rng.choice(["{}", '{"a":1}', None]), rng.choice(["ok", "bad", None])) for _ in range(p)]
            for k in range(rng.choice([1, 3, 12, 26, 40])):
                calls.append((key, ts, *pattern[k % p]))
                ts += 1
    frame = spark.createDataFrame(calls, "key int, ts int, tool string, params string, result string")
    got = batch.loops(frame, "key", "ts", "tool", "tool", "params", "result", POLLS).select("key", "ts", "repeats", "still", "period", "cycle", "level", "detector")
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(calls, 5, batch.HISTORY, batch.WARNING, batch.CRITICAL, batch.BREAKER)
    assert {r[-1] for r in got} == {None, "breaker", "poll", "ping_pong", "cycle", "repeat"}
    few = batch.loops(frame, "key", "ts", "tool", "tool", "params", "result", POLLS, 3, 6, 2, 4, 5).select("key", "ts", "repeats", "still", "period", "cycle", "level", "detector")
    assert sorted(map(tuple, few.collect()), key=str) == brute(calls, 3, 6, 2, 4, 5)


def test_no_calls(spark):
    assert batch.loops(spark.createDataFrame([], "key int, ts int, tool string, params string, result string"), "key", "ts", "tool", "tool", "params", "result", POLLS).collect() == []
