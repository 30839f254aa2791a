"""Operators on inbound events, at rest and as streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.plans.registry import Registry, Tables
from larkspur.scratch import scratch_path
from larkspur.streaming import batch, caches, debounce, stateful

R = Registry()
HOUR = 3_600_000


@R.query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) < 3600000000 * 6, false) AS is_duplicate FROM events")
def str1_dedupe_ttl(t: Tables) -> DataFrame:
    e = t.events.withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return batch.ttl_duplicates(e, "key", "ts", "event_id", 6 * HOUR).select("event_id", "is_duplicate")


@R.query("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000, true)::INT AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM i GROUP BY user_id, k""")
def str3_debounce_sessions(t: Tables) -> DataFrame:
    return batch.debounced(t.events, "user_id", "ts", "30 minutes")


@R.query("""WITH g AS (SELECT *, event_type = 'error' AS c, (coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 21600000000, true) OR event_type = 'error' OR coalesce(lag(event_type) OVER w = 'error', false))::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS batch FROM g) SELECT user_id, batch::BIGINT AS batch, min(ts) AS start, count(*) AS n, bool_or(c) AS is_control FROM i GROUP BY 1, 2""")
def str3_debounce_control(t: Tables) -> DataFrame:
    return batch.debounced_with_control(t.events, "user_id", "ts", "event_id", 6 * HOUR, F.col("event_type") == "error")


@R.query("SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch_us(ts) / 86400000000) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def str4_fixed_window(t: Tables) -> DataFrame:
    return batch.aligned_limit(t.events, "user_id", "ts", "event_id", 2, 86_400).select("event_id", "allowed")


@R.query("SELECT event_id, count(*) OVER w AS recent, count(*) OVER w > 3 AS over FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
def str5_sliding_limit(t: Tables) -> DataFrame:
    return batch.sliding_counts(t.events, "user_id", "ts", 86_400, 3).select("event_id", "recent", "over")


@R.query("""WITH g AS (SELECT *, coalesce(lag(event_type) OVER w <> event_type, true)::INT AS new, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS l FROM g)
SELECT event_id, len(list_filter(l, lambda x: x = event_type))::INT AS seen, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id)::INT AS run FROM i""")
def str11_repeats(t: Tables) -> DataFrame:
    return batch.repeats(t.events, "user_id", "ts", "event_id", "event_type").select("event_id", "seen", "run")


@R.query("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000, true)::INT AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, count(DISTINCT event_type) <= 1 AS merge FROM i GROUP BY user_id, k""")
def str7_drain_routes(t: Tables) -> DataFrame:
    return batch.batch_routes(t.events, "user_id", "ts", "12 hours", "event_type")


@R.query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def snk11_cap(t: Tables) -> DataFrame:
    return batch.kept_entries(t.events, "ts", "event_id", 100).select("event_id", "ts")


@R.query("""WITH f AS (SELECT source, doc_id, n_chars FROM documents), a AS (SELECT source, sum(n_chars) AS total FROM f GROUP BY 1), u AS (SELECT f.* FROM f ANTI JOIN labels USING (doc_id)),
c AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM u) SELECT source, doc_id FROM c JOIN a USING (source) WHERE total - freed > 100000""")
def snk12_disk_budget(t: Tables) -> DataFrame:
    files = t.documents.select("source", "doc_id", "n_chars", F.col("doc_id").alias("age"))
    return batch.within_budget(files, "n_chars", "age", t.labels.select("doc_id").distinct(), "doc_id", 100_000, "source").select("source", "doc_id")


def ran(t: Tables, name: str, made) -> DataFrame:
    """What a stream over the events table, taken once to its end, has put out: a table in the shared folder, as is its
    checkpoint, so a stream that was stopped would go on where it was."""
    path = scratch_path(t.spark, name)
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    out = made(source)
    out.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start(path).awaitTermination()
    return t.spark.read.schema(out.schema).parquet(path)


@R.query()
def strx_dedupe_stream(t: Tables) -> DataFrame:
    return ran(t, "strx_dedupe", lambda s: stateful.deduplicated(s, ["user_id", "event_type"], "ts", "6 hours").select("event_id"))


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@R.query(f"""WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 1800000000, true)::INT AS new FROM events), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM i GROUP BY user_id, k) SELECT * FROM s WHERE "end" <= {CLOSED}""")
def strx_sessions_stream(t: Tables) -> DataFrame:
    return ran(t, "strx_sessions", lambda s: stateful.session_runs(s, "user_id", "ts", "30 minutes", "1 hour"))


@R.query(f"""SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= {CLOSED}""")
def strx_tumbling_stream(t: Tables) -> DataFrame:
    return ran(t, "strx_tumbling", lambda s: stateful.tumbling(s, "event_type", "ts", "1 day", "1 hour"))


@R.query()
def str5_lockout_stream(t: Tables) -> DataFrame:
    step = stateful.lockout_step(3, 24 * HOUR, 12 * HOUR)
    return ran(t, "str5_lockout", lambda s: stateful.applied(s.withColumn("kind", F.when(F.col("event_type") == "error", "failure").otherwise("check")), "user_id", "ts", "kind", step, "allowed boolean, remaining int, retry_after long", 48 * HOUR))


@R.query()
def str4_anchored_stream(t: Tables) -> DataFrame:
    step = stateful.fixed_window_step(2, 24 * HOUR)
    return ran(t, "str4_anchored", lambda s: stateful.applied(s, "user_id", "ts", "event_type", step, "allowed boolean, remaining int, retry_after long", 48 * HOUR))


@R.query()
def str6_queue_stream(t: Tables) -> DataFrame:
    step = stateful.queue_step(5, "summarize")
    return ran(t, "str6_queue", lambda s: stateful.applied(s, "user_id", "ts", "event_id", step, "queued boolean, size int, dropped int", 480 * HOUR))


@R.query("""WITH e AS (SELECT user_id || ':' || event_type AS key, epoch_us(ts) // 1000 AS ts, event_id::VARCHAR AS item FROM events)
SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, item) < 21600000, false) AS is_duplicate FROM e""")
def str1_ttl_stream(t: Tables) -> DataFrame:
    step = stateful.ttl_step(6 * HOUR)
    return ran(t, "str1_ttl", lambda s: stateful.applied(s.withColumn("key", F.concat_ws(":", "user_id", "event_type")), "key", "ts", "event_id", step, "is_duplicate boolean", 12 * HOUR))


LRU = """WITH RECURSIVE e AS (SELECT event_type AS namespace, user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ts, event_id::VARCHAR AS item, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id::VARCHAR) AS n FROM events),
run(namespace, n, key, ts, item, is_duplicate, cache) AS (
    SELECT DISTINCT namespace, 0::BIGINT, '', 0::BIGINT, '', false, []::STRUCT(k VARCHAR, t BIGINT)[] FROM e
    UNION ALL
    SELECT namespace, n, key, ts, item, hit, (list_append(CASE WHEN hit THEN rest ELSE list_filter(rest, lambda x: x.t >= ts - 43200000) END, {{'k': key, 't': ts}}))[-25:]
    FROM (SELECT e.*, len(list_filter(cache, lambda x: x.k = e.key AND e.ts - x.t < 43200000)) > 0 AS hit, list_filter(cache, lambda x: x.k <> e.key) AS rest FROM run JOIN e ON e.namespace = run.namespace AND e.n = run.n + 1)),"""


@R.query(LRU.replace("{{", "{").replace("}}", "}") + " x AS (SELECT 1) SELECT namespace, key, ts, item, is_duplicate, len(cache)::INT AS size FROM run WHERE n > 0")
def str1_bounded_stream(t: Tables) -> DataFrame:
    """Of each type of event the 25 users seen last, for 12 hours."""
    with caches.rocksdb(t.spark):
        return ran(t, "str1_bounded", lambda s: caches.deduplicated(s, "event_type", "user_id", "ts", "event_id", 12 * HOUR, 25)).drop("gone")


@R.query("""WITH RECURSIVE e AS (SELECT event_type AS namespace, user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ts, event_id::VARCHAR AS item, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id::VARCHAR) AS n FROM events),
run(namespace, n, key, ts, item, is_duplicate, gone, cache, file) AS (
    SELECT DISTINCT namespace, 0::BIGINT, '', 0::BIGINT, '', false, 0::BIGINT, []::STRUCT(k VARCHAR, t BIGINT)[], []::STRUCT(k VARCHAR, t BIGINT)[] FROM e
    UNION ALL
    SELECT namespace, n, key, ts, item, hit OR recent, CASE WHEN hit OR recent THEN 0 ELSE len(file) + CASE WHEN len(old) > 0 THEN 0 ELSE 1 END - len(next_file) END, next_cache, CASE WHEN hit OR recent THEN file ELSE next_file END
    FROM (SELECT *, (list_append(CASE WHEN hit THEN rest ELSE list_filter(rest, lambda x: x.t >= ts - 86400000) END, {'k': key, 't': ts}))[-5:] AS next_cache,
        (list_append(list_filter(file, lambda x: x.k <> key AND ts - x.t < 86400000), {'k': key, 't': ts}))[-40:] AS next_file
        FROM (SELECT e.*, cache, file, len(list_filter(cache, lambda x: x.k = e.key AND e.ts - x.t < 86400000)) > 0 AS hit, list_filter(cache, lambda x: x.k <> e.key) AS rest,
            list_filter(file, lambda x: x.k = e.key) AS old, len(list_filter(file, lambda x: x.k = e.key AND e.ts - x.t < 86400000)) > 0 AS recent FROM run JOIN e ON e.namespace = run.namespace AND e.n = run.n + 1)))
SELECT namespace, key, ts, item, is_duplicate, len(file)::INT AS size, gone::INT AS gone FROM run WHERE n > 0""")
def str2_bounded_stream(t: Tables) -> DataFrame:
    """Of each type of event a cache of 5 users and a record of 40, for a day: what lets go of whom."""
    with caches.rocksdb(t.spark):
        return ran(t, "str2_bounded", lambda s: caches.deduplicated(s, "event_type", "user_id", "ts", "event_id", 24 * HOUR, 5, 40)).withColumn("gone", F.size("gone"))


def numbered(item: str) -> str:
    """A user's events in the order in which streams take them, for SQL that follows a state from one to the next."""
    return f"e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ts, {item} AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts, {item}) AS n FROM events)"


R.sql["str4_anchored_stream"] = f"""WITH RECURSIVE {numbered("event_type")}, run(key, n, ts, item, start, used, allowed) AS (
    SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, '', -86400000::BIGINT, 0, false FROM e
    UNION ALL
    SELECT key, n, ts, item, s, CASE WHEN u < 2 THEN u + 1 ELSE u END, u < 2
    FROM (SELECT e.*, CASE WHEN e.ts - start >= 86400000 THEN e.ts ELSE start END AS s, CASE WHEN e.ts - start >= 86400000 THEN 0 ELSE used END AS u FROM run JOIN e ON e.key = run.key AND e.n = run.n + 1))
SELECT key, ts, item, allowed, CASE WHEN allowed THEN 2 - used ELSE 0 END AS remaining, CASE WHEN allowed THEN 0 ELSE start + 86400000 - ts END AS retry_after FROM run WHERE n > 0"""
KIND = "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'check' END"
R.sql["str5_lockout_stream"] = f"""WITH RECURSIVE {numbered(KIND)}, run(key, n, ts, item, until, log) AS (
    SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, '', 0::BIGINT, []::BIGINT[] FROM e
    UNION ALL
    SELECT key, n, ts, item, CASE WHEN locked THEN before WHEN item = 'failure' AND len(l) >= 3 THEN ts + 43200000 ELSE 0 END, CASE WHEN locked THEN kept ELSE l END
    FROM (SELECT *, CASE WHEN item = 'failure' THEN list_append(list_filter(kept, lambda x: x > ts - 86400000), ts) ELSE list_filter(kept, lambda x: x > ts - 86400000) END AS l
        FROM (SELECT e.*, until AS before, until > e.ts AS locked, CASE WHEN until > 0 AND e.ts >= until THEN [] ELSE log END AS kept FROM run JOIN e ON e.key = run.key AND e.n = run.n + 1)))
SELECT key, ts, item, until = 0 AS allowed, CASE WHEN until > 0 THEN 0 ELSE greatest(0, 3 - len(log)) END::INT AS remaining, CASE WHEN until > 0 THEN until - ts ELSE 0 END AS retry_after FROM run WHERE n > 0"""
R.sql["str6_queue_stream"] = f"""WITH RECURSIVE {numbered("event_id::VARCHAR")}, run(key, n, ts, item, items, queued, dropped) AS (
    SELECT DISTINCT key, 0::BIGINT, 0::BIGINT, '', []::VARCHAR[], false, 0 FROM e
    UNION ALL
    SELECT key, n, ts, item, CASE WHEN there THEN items ELSE (list_append(items, item))[-5:] END, NOT there, dropped + CASE WHEN NOT there AND len(items) >= 5 THEN 1 ELSE 0 END
    FROM (SELECT e.*, items, dropped, list_contains(items, e.item) AS there FROM run JOIN e ON e.key = run.key AND e.n = run.n + 1))
SELECT key, ts, item, queued, len(items)::INT AS size, dropped::INT AS dropped FROM run WHERE n > 0"""


@R.query("""WITH c AS (SELECT event_id, user_id, ts, event_type AS tool, (value > 30)::INT AS result, event_type || ' ' || (value > 30)::INT AS whole FROM events),
l AS (SELECT *, list(tool) OVER w AS tools, list(whole) OVER w AS a FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
m AS (SELECT *, len(list_filter(tools, lambda x: x = tool)) AS repeats, list_transform([1, 2, 3, 4, 5], lambda p: len(a) - p - coalesce(list_max(list_filter(range(1, len(a) - p + 1), lambda i: a[i] <> a[i + p])), 0)) AS runs FROM l),
f AS (SELECT *, greatest(runs[1], 0) + 1 AS still, list_filter([2, 3, 4, 5], lambda p: runs[p] >= p) AS ps FROM m),
g AS (SELECT *, coalesce(list_max(list_transform(ps, lambda p: runs[p] + p)), 0) AS c FROM f),
h AS (SELECT *, CASE WHEN c > still THEN c ELSE 0 END AS cycle, CASE WHEN c > still THEN list_min(list_filter(ps, lambda p: runs[p] + p = c)) ELSE 0 END AS period FROM g),
v AS (SELECT *, CASE WHEN still >= 7 THEN 2 ELSE 0 END AS v1, CASE WHEN tool = 'view' AND still >= 5 THEN 2 WHEN tool = 'view' AND still >= 3 THEN 1 ELSE 0 END AS v2, CASE WHEN period = 2 AND cycle >= 5 THEN 2 WHEN period = 2 AND cycle >= 3 THEN 1 ELSE 0 END AS v3,
    CASE WHEN period > 2 AND cycle >= 5 THEN 2 WHEN period > 2 AND cycle >= 3 THEN 1 ELSE 0 END AS v4, CASE WHEN repeats >= 5 THEN 2 WHEN repeats >= 3 THEN 1 ELSE 0 END AS v5 FROM h)
SELECT event_id, repeats::INT AS repeats, still::INT AS still, period::INT AS period, cycle::INT AS cycle, CASE greatest(v1, v2, v3, v4, v5) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' END AS level,
CASE WHEN greatest(v1, v2, v3, v4, v5) = 0 THEN NULL WHEN v1 = greatest(v1, v2, v3, v4, v5) THEN 'breaker' WHEN v2 = greatest(v1, v2, v3, v4, v5) THEN 'poll' WHEN v3 = greatest(v1, v2, v3, v4, v5) THEN 'ping_pong' WHEN v4 = greatest(v1, v2, v3, v4, v5) THEN 'cycle' ELSE 'repeat' END AS detector FROM v""")
def str11_loops(t: Tables) -> DataFrame:
    """With thresholds of 3, 5 and 7 in the last 12 calls, so that the table's calls reach them all."""
    calls = t.events.select("event_id", "user_id", "ts", F.col("event_type").alias("tool"), F.lit("{}").alias("params"), (F.col("value") > 30).cast("int").alias("result"))
    d = batch.loops(calls, "user_id", "ts", "event_id", "tool", "params", "result", ["view"], 5, 12, 3, 5, 7)
    return d.select("event_id", "repeats", "still", "period", "cycle", "level", "detector")


def waiting() -> tuple:
    """How long an event waits for more, by its type, and whether it may."""
    kind = F.col("event_type")
    return F.when(kind == "click", 2 * HOUR).when(kind == "view", 12 * HOUR).otherwise(F.floor("value").cast("long") * 600_000), kind != "error"


ITEM_GAPS = """WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // 1000 AS ts, event_id::VARCHAR AS item, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 7200000 WHEN 'view' THEN 43200000 ELSE floor(value)::BIGINT * 600000 END AS gap FROM events),
n AS (SELECT *, (gap = 0 OR coalesce(lag(gap) OVER w = 0, true) OR ts >= lag(ts) OVER w + lag(gap) OVER w)::INT AS new, CASE WHEN lead(gap) OVER w = 0 THEN lead(ts) OVER w END AS alone FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, item)),
i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts, item ROWS UNBOUNDED PRECEDING) AS k FROM n),
b AS (SELECT key, min(ts) AS start, max(ts) AS last, string_agg(item, ' ' ORDER BY ts, item) AS items, arg_max(gap, (ts, item)) AS gap, last(alone ORDER BY ts, item) AS alone FROM i GROUP BY key, k),
f AS (SELECT key, start, last, items, CASE WHEN alone < last + gap THEN alone ELSE last + gap END AS flushed_at, CASE WHEN gap = 0 THEN 'alone' WHEN alone < last + gap THEN 'flush' ELSE 'gap' END AS reason FROM b) SELECT * FROM f"""


@R.query(ITEM_GAPS)
def str3_item_gaps(t: Tables) -> DataFrame:
    return debounce.batches(t.events, "user_id", "ts", "event_id", *waiting()).withColumn("items", F.array_join("items", " "))


@R.query(ITEM_GAPS + " WHERE flushed_at <= (SELECT max(ts) FROM e) - 3600000")
def str3_item_gaps_stream(t: Tables) -> DataFrame:
    """The same as a stream, up to its watermark; the last batch is written again as if its checkpoint had been lost."""
    path = scratch_path(t.spark, "str3_gaps")
    source = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    write = debounce.flushed_to(f"{path}/out", lambda d: d.withColumn("items", F.array_join("items", " ")))

    def twice(d: DataFrame, batch_id: int) -> None:
        write(d, batch_id)
        write(d, batch_id)

    with caches.rocksdb(t.spark):
        out = debounce.stream(source, "user_id", "ts", "event_id", *waiting(), delay="1 hour")
        out.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out").drop("batch")
