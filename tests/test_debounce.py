"""Items with gaps of their own, at rest and as a stream that comes in any order, against a clock that is turned by hand."""

import random

from pyspark.sql import functions as F

from larkspur.streaming import caches, debounce


def brute(events):
    """events (key, ts, item, gap, waits) as key, start, last, items, flushed_at, reason."""
    out, buffers = [], {}

    def flush(key, at, reason):
        b = buffers.pop(key)
        out.append((key, b[0][0], b[-1][0], tuple(x[1] for x in b), at, reason))

    for key, ts, item, gap, waits in sorted(events, key=lambda e: (e[1], e[2])):
        gap = max(0, gap or 0) if waits and key else 0
        if key in buffers and ts >= (due := buffers[key][-1][0] + buffers[key][-1][2]):
            flush(key, due, "gap")
        if gap:
            buffers.setdefault(key, []).append((ts, item, gap))
            continue
        if key in buffers:
            flush(key, ts, "flush")
        buffers[key] = [(ts, item, 0)]
        flush(key, ts, "alone")
    for key in list(buffers):
        flush(key, buffers[key][-1][0] + buffers[key][-1][2], "gap")
    return sorted(out, key=str)


def events(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", "", None]), rng.randrange(200_000), f"{k:03d}", rng.choice([None, -5, 0, 500, 4000, 20_000]), rng.choice([True, True, True, False, None])) for k in range(n)]


def frame(spark, rows):
    d = spark.createDataFrame(rows, "key string, ms long, item string, gap long, waits boolean")
    return d.withColumn("ts", F.timestamp_millis("ms"))


def rows_of(d):
    return sorted(((r.key, r.start, r.last, tuple(r["items"]), r.flushed_at, r.reason) for r in d.collect()), key=str)


def test_at_rest(spark):
    rows = events(300, 1)
    got = debounce.batches(frame(spark, rows), "key", "ts", "item", F.col("gap"), F.col("waits"))
    assert rows_of(got) == brute(rows)
    assert debounce.batches(frame(spark, []), "key", "ts", "item", F.col("gap")).collect() == []


def test_as_a_stream_in_any_order_and_with_a_batch_that_comes_again(spark, tmp_path):
    rows = [(k or "", *r) for k, *r in events(200, 2)]
    shuffled = sorted(rows, key=lambda e: e[1] + random.Random(e[2]).randrange(30_000))  # within the delay
    parts = [shuffled[i : i + 50] for i in range(0, 200, 50)] + [[("end", 900_000, "end", 0, True)]]
    write, seen = debounce.flushed_to(f"{tmp_path}/out"), []

    def again(d, batch_id):
        write(d, batch_id)
        write(d.limit(0) if not seen else d, batch_id)  # a first try that did not get far
        write(d, batch_id)
        seen.append(batch_id)

    for part in parts:
        frame(spark, part).drop("ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("key string, ms long, item string, gap long, waits boolean").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_millis("ms"))
        with caches.rocksdb(spark):
            out = debounce.stream(source, "key", "ts", "item", F.col("gap"), F.col("waits"), delay="60 seconds")
            out.writeStream.foreachBatch(again).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.parquet(f"{tmp_path}/out").drop("batch").where("key <> 'end'")) == brute(rows)


def test_keys_share_a_bounded_number_of_groups(spark, tmp_path):
    rows = [(f"k{i % 1500}", 1000 * (1 + i // 1500), f"{i}", 700 + i % 5 * 200, i % 7 > 0) for i in range(4500)]
    frame(spark, [*rows, ("end", 900_000, "end", 0, True)]).drop("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("key string, ms long, item string, gap long, waits boolean").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_millis("ms"))
    with caches.rocksdb(spark):
        out = debounce.stream(source, "key", "ts", "item", F.col("gap"), F.col("waits"), delay="60 seconds")
        q = out.writeStream.foreachBatch(debounce.flushed_to(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    assert rows_of(spark.read.parquet(f"{tmp_path}/out").drop("batch").where("key <> 'end'")) == brute(rows)
    assert debounce.BUCKETS < 1500 and "bucket" in q._jsq.explainInternal(False)
