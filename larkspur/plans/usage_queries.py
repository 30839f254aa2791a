"""Usage analytics: events as samples (value as milliseconds or tokens, event_type as model, user_id as session)."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import filters, keys
from larkspur.functions import time as tm
from larkspur.functions import usage as fu
from larkspur.operators import usage
from larkspur.plans.registry import Registry, Tables
from larkspur.sources import writers

R = Registry()

P95 = "list_sort(list(value))[least(floor(count(value) * 0.95)::INT, count(value)::INT - 1) + 1]"
SESSION = f"SELECT user_id, event_type, count(value) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, {P95} AS p95 FROM events GROUP BY ALL"
OUT = "count, round(sum, 6) AS sum, min, max, {p95}, round(sum / count, 6) AS avg"


def rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({"sum": F.round("sum", 6), "avg": F.round("avg", 6)})


@R.query(f"WITH s AS ({SESSION}) SELECT event_type, {OUT.format(p95='p95_max')} FROM (SELECT event_type, sum(count)::BIGINT AS count, sum(sum) AS sum, min(min) AS min, max(max) AS max, max(p95) AS p95_max FROM s GROUP BY event_type)")
def agg1_latency_merge(t: Tables) -> DataFrame:
    per = usage.latency(t.events, ["user_id", "event_type"], "value").drop("avg")
    return rounded(usage.merge_latency(per, ["event_type"]))


@R.query(f"SELECT day, {OUT.format(p95='p95')} FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(value) AS count, sum(value) AS sum, min(value) AS min, max(value) AS max, {P95} AS p95 FROM events GROUP BY 1)")
def agg2_daily_latency(t: Tables) -> DataFrame:
    return rounded(usage.latency(t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day"], "value"))


@R.query("SELECT c_mktsegment AS channel, count(*) AS sessions, round(sum(o_totalprice), 2) AS total_cost FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg3_by_channel(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("channel"))
    return d.agg(F.count("*").alias("sessions"), F.round(F.sum("o_totalprice"), 2).alias("total_cost")).orderBy(F.desc("total_cost"))


@R.query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS model, count(*) AS n, round(sum(value), 6) AS cost FROM events GROUP BY ALL")
def agg4_model_daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("cost")).orderBy("day", F.desc("cost"))


@R.query("""SELECT o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS cost,
CASE WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' WHEN grouping(c_mktsegment) = 0 THEN 'segment' ELSE 'total' END AS dim
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), (c_mktsegment), ())""")
def agg5_grouping_sets(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"), "o_totalprice")
    return usage.rollup_sets(d, ["status", "priority", "segment"], [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("cost")])


@R.query("SELECT event_type, count(*) AS entries, count(*) FILTER (value < 2) AS missing, round(sum(CASE WHEN value >= 2 THEN value END), 6) AS cost FROM events GROUP BY 1")
def agg6_missing_cost(t: Tables) -> DataFrame:
    cost = F.when(F.col("value") >= 2, F.col("value"))
    return t.events.groupBy("event_type").agg(F.count("*").alias("entries"), F.count_if(cost.isNull()).alias("missing"), F.round(F.sum(cost), 6).alias("cost"))


@R.query("SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (role = 'system') AS systems FROM conversations GROUP BY 1")
def agg7_role_counts(t: Tables) -> DataFrame:
    roles = {"users": "user", "assistants": "assistant", "systems": "system"}
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("role") == r).alias(n) for n, r in roles.items()])


@R.query("SELECT event_type AS name, count(*) AS calls, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg8_tool_usage(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users")).orderBy(F.desc("calls"))


@R.query("SELECT user_id, min(ts) AS first, max(ts) AS last, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS duration_s, array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y-%m-%d'))), ',') AS days FROM events GROUP BY 1")
def agg9_session_summary(t: Tables) -> DataFrame:
    d = usage.session_summary(t.events, "user_id", "ts")
    return d.withColumns({"duration_s": F.round("duration_s", 6), "days": F.array_join("days", ",")})


RUNS = "SELECT user_id AS job, event_type AS model, CASE WHEN event_id % 7 > 0 THEN value - 3 END AS input, CASE WHEN event_id % 5 > 0 THEN value END AS output, CASE WHEN event_id % 3 = 0 THEN 2 * value END AS total FROM events"


@R.query(f"""WITH r AS ({RUNS}), c AS (SELECT *, greatest(0, floor(coalesce(input, 0)))::BIGINT AS i, greatest(0, floor(coalesce(output, 0)))::BIGINT AS o, greatest(0, floor(coalesce(total, coalesce(input, 0) + coalesce(output, 0))))::BIGINT AS t FROM r)
SELECT job, model, count(*) AS runs, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(t)::BIGINT AS total_tokens, count(*) FILTER (input IS NULL AND output IS NULL AND total IS NULL) AS missing_usage, grouping(model)::INT AS is_total FROM c GROUP BY GROUPING SETS ((job, model), (job))""")
def agg10_rollup_job_model(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    runs = t.events.select(F.col("user_id").alias("job"), F.col("event_type").alias("model"), F.when(e % 7 > 0, v - 3).alias("input"), F.when(e % 5 > 0, v).alias("output"), F.when(e % 3 == 0, 2 * v).alias("total"))
    return usage.runs_by_model(runs)


@R.query("SELECT round(sum(value), 6) AS tokens, round(sum(value / 10), 6) AS cost, count(*) FILTER (event_id % 2 = 1) AS user_messages, count(*) FILTER (event_id % 3 > 0) AS assistant_messages, max(event_id) - min(event_id) AS duration FROM events WHERE event_id BETWEEN 100 AND 5000")
def agg11_range_totals(t: Tables) -> DataFrame:
    e = F.col("event_id")
    points = t.events.select(e.alias("ts"), F.col("value").alias("tokens"), (F.col("value") / 10).alias("cost"), (e % 2).alias("input"), (e % 3).alias("output"))
    d = usage.range_totals(points, F.lit(5000), F.lit(100))
    return d.withColumns({"tokens": F.round("tokens", 6), "cost": F.round("cost", 6)})


@R.query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(coalesce(o_totalprice, 0)), 2) AS cost, count(*) AS n FROM orders GROUP BY 1")
def agg12_daily_cost(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum(F.coalesce("o_totalprice", F.lit(0.0))), 2).alias("cost"), F.count("*").alias("n"))


@R.query("SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY 1")
def agg13_session_ends(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@R.query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1")
def agg14_category_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"))


@R.query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def agg15_tier_metrics(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean"))


@R.query("SELECT 'documents' AS kind, source AS part, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'vectors', label::VARCHAR, count(*) FROM embeddings GROUP BY 2")
def agg16_index_counts(t: Tables) -> DataFrame:
    docs = t.documents.groupBy(F.lit("documents").alias("kind"), F.col("source").alias("part")).agg(F.count("*").alias("n"))
    return docs.unionByName(t.embeddings.groupBy(F.lit("vectors").alias("kind"), F.col("label").cast("string").alias("part")).agg(F.count("*").alias("n")))


@R.query("""WITH g AS (SELECT DISTINCT user_id, event_type FROM events), p AS (SELECT a.event_type AS tag, b.event_type AS other, count(*) AS n FROM g a JOIN g b USING (user_id) WHERE a.event_type <> b.event_type GROUP BY ALL)
SELECT tag, other, n FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS r FROM p) WHERE r <= 5""")
def agg18_tag_cooccurrence(t: Tables) -> DataFrame:
    g = t.events.select("user_id", "event_type").distinct()
    p = g.withColumnRenamed("event_type", "tag").join(g.withColumnRenamed("event_type", "other"), "user_id").where("tag <> other").groupBy("tag", "other").agg(F.count("*").alias("n"))
    return p.withColumn("r", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), "other"))).where("r <= 5").drop("r")


@R.query(f"SELECT event_type, {P95} AS p95, {P95.replace('0.95', '0.5')} AS p50, {P95.replace('0.95', '0.99')} AS p99 FROM events GROUP BY 1")
def agg19_nearest_rank(t: Tables) -> DataFrame:
    return usage.percentiles(t.events, ["event_type"], "value", {"p95": 0.95, "p50": 0.5, "p99": 0.99})


@R.query("SELECT user_id, count(*) AS ops, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS ops_per_s, round(avg(value), 6) AS mean, avg(value) < 20 AS meets FROM events GROUP BY 1 HAVING max(ts) > min(ts)")
def agg20_throughput(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = t.events.groupBy("user_id").agg(F.count("*").alias("ops"), ((F.max(us) - F.min(us)) / 1e6).alias("s"), F.avg("value").alias("m")).where("s > 0")
    return g.select("user_id", "ops", F.round(F.col("ops") / F.col("s"), 9).alias("ops_per_s"), F.round("m", 6).alias("mean"), (F.col("m") < 20).alias("meets"))


@R.query("SELECT user_id, arg_max(event_type, (value, -event_id)) AS window, max(value) AS used FROM events GROUP BY 1")
def agg21_max_window(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("value", -F.col("event_id"))).alias("window"), F.max("value").alias("used"))


@R.query("""WITH l AS (SELECT user_id, unnest(regexp_extract_all('[Tool: ' || event_type || '] x [Tool: k' || (event_id % 3) || ']', '\\[Tool: ([^\\]]+)\\]', 1)) AS tool FROM events) SELECT tool, count(*) AS n FROM l GROUP BY 1""")
def agg22_tool_summary(t: Tables) -> DataFrame:
    line = F.concat(F.lit("[Tool: "), "event_type", F.lit("] x [Tool: k"), F.col("event_id") % 3, F.lit("]"))
    return t.events.select(F.explode(F.regexp_extract_all(line, F.lit(r"\[Tool: ([^\]]+)\]"), F.lit(1))).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


@R.query("SELECT event_id, user_id, round(sum(value) OVER w, 6) AS cum_value, (sum(length(props)) OVER w)::BIGINT AS cum_size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def win1_cumulative(t: Tables) -> DataFrame:
    d = usage.cumulative(t.events.withColumn("size", F.length("props")), "user_id", ["ts", "event_id"], ["value", "size"])
    return d.select("event_id", "user_id", F.round("cum_value", 6).alias("cum_value"), "cum_size")


COST = """WITH r AS (SELECT p_partkey, p_size / 10 AS i, p_size / 5 AS o FROM part WHERE p_partkey % 10 > 0)
SELECT l_orderkey, l_linenumber, round((l_quantity * i + l_extendedprice * o) / 1000000, 9) AS cost FROM lineitem LEFT JOIN r ON l_partkey = p_partkey"""


@R.query(COST)
def prj9_cost_estimate(t: Tables) -> DataFrame:
    rates = t.part.where("p_partkey % 10 > 0").select("p_partkey", (F.col("p_size") / 10).alias("i"), (F.col("p_size") / 5).alias("o"))
    d = t.lineitem.join(rates, F.col("l_partkey") == F.col("p_partkey"), "left")
    return d.select("l_orderkey", "l_linenumber", F.round(fu.cost({"i": F.col("l_quantity"), "o": F.col("l_extendedprice")}, {"i": F.col("i"), "o": F.col("o")}), 9).alias("cost"))


RAW = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value - 20 END AS input, CASE WHEN event_id % 4 > 1 THEN value END AS prompt_tokens, CASE WHEN event_id % 3 > 0 THEN value * 2 END AS output_tokens, CASE WHEN event_id % 5 = 0 THEN 7.0::DOUBLE END AS cached_tokens, NULL::DOUBLE AS total_tokens FROM events"


def raw_usage(t: Tables) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    raw = F.struct(F.when(e % 4 == 0, v - 20).alias("input"), F.when(e % 4 > 1, v).alias("prompt_tokens"), F.when(e % 3 > 0, v * 2).alias("output_tokens"), F.when(e % 5 == 0, F.lit(7.0)).alias("cached_tokens"), F.lit(None).cast("double").alias("total_tokens"))
    d = t.events.select("event_id", raw.alias("raw"))
    return d.withColumn("u", fu.normalised(d, "raw"))


@R.query(f"WITH r AS ({RAW}) SELECT event_id, CASE WHEN coalesce(input, prompt_tokens) < 0 THEN 0 ELSE coalesce(input, prompt_tokens) END AS input, output_tokens AS output, cached_tokens AS cache_read, coalesce(input, prompt_tokens, output_tokens, cached_tokens, total_tokens) IS NOT NULL AS there FROM r")
def prj7_normalise_usage(t: Tables) -> DataFrame:
    return raw_usage(t).select("event_id", "u.input", "u.output", "u.cache_read", F.col("u").isNotNull().alias("there"))


@R.query(f"WITH r AS ({RAW}), p AS (SELECT event_id, greatest(coalesce(input, prompt_tokens, 0), 0) + coalesce(cached_tokens, 0) AS s FROM r) SELECT event_id, CASE WHEN s > 0 THEN s END AS prompt, CASE WHEN event_id % 10 = 0 AND event_id > 0 THEN event_id::DOUBLE WHEN s > 0 THEN s END AS total FROM p")
def prj8_prompt_tokens(t: Tables) -> DataFrame:
    override = F.when(F.col("event_id") % 10 == 0, F.col("event_id").cast("double"))
    return raw_usage(t).select("event_id", fu.prompt_tokens(F.col("u")).alias("prompt"), fu.session_total(F.col("u"), override).alias("total"))


def _printf(x: str, places: int) -> str:
    """printf, which goes to the even one of two numbers as near, made to go up."""
    halves = {0: 2, 1: 4, 2: 8}[places]
    tie = f"{x} * {halves} = floor({x} * {halves}) AND floor({x} * {halves})::BIGINT % 2 = 1"
    return f"printf('%.{places}f', CASE WHEN {tie} THEN nextafter({x}, 'Infinity'::DOUBLE) ELSE {x} END)"


@R.query(f"""SELECT o_orderkey, CASE WHEN x >= 1000000 THEN {_printf("(x / 1000000)", 1)} || 'm' WHEN x >= 10000 THEN {_printf("(x / 1000)", 0)} || 'k' WHEN x >= 1000 THEN {_printf("(x / 1000)", 1)} || 'k' ELSE floor(greatest(x, 0) + 0.5)::BIGINT::VARCHAR END AS tokens,
'$' || {_printf("x", 2)} AS usd FROM (SELECT o_orderkey, o_totalprice AS x FROM orders)""")
def prj10_formats(t: Tables) -> DataFrame:
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", fu.format_tokens(x).alias("tokens"), fu.format_usd(x).alias("usd"))


@R.query("SELECT o_orderkey, CASE WHEN o_custkey > 0 THEN least(999, floor(o_orderkey / o_custkey * 100 + 0.5))::BIGINT END AS percent, o_orderkey < 32000 AND o_orderkey > 0 AS should_warn, o_orderkey < 16000 AND o_orderkey > 0 AS should_block FROM orders")
def prj16_context_share(t: Tables) -> DataFrame:
    d = t.orders.select("o_orderkey", fu.context_percent(F.col("o_orderkey"), F.col("o_custkey")).alias("percent"), fu.context_guard(F.col("o_orderkey")).alias("g"))
    return d.select("o_orderkey", "percent", "g.should_warn", "g.should_block")


KEYS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'agent:Main:cron:' || user_id || ':run:' || event_id WHEN 1 THEN 'agent:a' || user_id || ':group:g:thread:' || event_id WHEN 2 THEN 'discord:x:guild-1:channel-2' WHEN 3 THEN 'agent:b:subagent:c:subagent:d' WHEN 4 THEN 'acp:' || event_id ELSE 'agent:c:telegram:dm:' || user_id END AS key FROM events"


def session_keys(t: Tables) -> DataFrame:
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("event_id") % 6
    key = (
        F.when(k == 0, F.concat(F.lit("agent:Main:cron:"), u, F.lit(":run:"), e)).when(k == 1, F.concat(F.lit("agent:a"), u, F.lit(":group:g:thread:"), e)).when(k == 2, "discord:x:guild-1:channel-2")
        .when(k == 3, "agent:b:subagent:c:subagent:d").when(k == 4, F.concat(F.lit("acp:"), e)).otherwise(F.concat(F.lit("agent:c:telegram:dm:"), u))
    )
    return t.events.select("event_id", key.alias("key"))


@R.query(f"""WITH k AS ({KEYS}), p AS (SELECT *, string_split(lower(key), ':') AS s FROM k), r AS (SELECT *, CASE WHEN s[1] = 'agent' AND len(s) >= 3 THEN array_to_string(s[3:], ':') END AS rest FROM p)
SELECT event_id, CASE WHEN rest IS NOT NULL THEN s[2] END AS agent, rest, CASE WHEN list_contains(string_split(coalesce(rest, lower(key)), ':'), 'group') THEN 'group' WHEN list_contains(s, 'channel') THEN 'channel' WHEN list_contains(s, 'dm') THEN 'direct' WHEN key LIKE 'discord:%guild-%channel-%' THEN 'channel' ELSE 'unknown' END AS chat,
coalesce(regexp_matches(rest, '^cron:[^:]+:run:[^:]+$'), false) AS cron_run, coalesce(rest LIKE 'subagent:%', false) AS subagent, len(string_split(lower(key), ':subagent:')) - 1 AS depth, key LIKE 'acp:%' AS acp, CASE WHEN contains(key, ':thread:') THEN string_split(key, ':thread:')[1] END AS parent FROM r""")
def prj4_session_keys(t: Tables) -> DataFrame:
    k = F.col("key")
    return session_keys(t).select("event_id", keys.agent_id(k).alias("agent"), keys.rest(k).alias("rest"), keys.chat_type(k).alias("chat"), keys.is_cron_run(k).alias("cron_run"), keys.is_subagent(k).alias("subagent"), keys.subagent_depth(k).cast("long").alias("depth"), keys.is_acp(k).alias("acp"), keys.thread_parent(k).alias("parent"))


def sessions(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return d.select(F.concat(F.lit("agent:main:cron:"), "o_orderkey").alias("key"), F.col("o_orderkey").alias("sessionId"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("channel"), F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("totalTokens"), (F.col("o_totalprice") / 1000).alias("totalCost"), (F.col("o_orderkey") % 5).alias("errors"))


@R.query("SELECT o_orderkey AS \"sessionId\" FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_mktsegment), 'build') AND o_totalprice >= 100000 AND o_totalprice / 1000 <= 300 AND o_orderkey % 5 > 0 AND regexp_matches('agent:main:cron:' || o_orderkey, '(?i)^agent:.*1.$') AND contains(lower(o_orderpriority), '1-urg')")
def flt1_usage_filter(t: Tables) -> DataFrame:
    d, _ = filters.sessions(sessions(t), 'channel:build minTokens:100k maxCost:$300 has:errors key:agent:*1? "model:1-URG" minTokens:what wat:1')
    return d.select("sessionId")


@R.query("SELECT c_mktsegment AS value, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")
def flt6_suggestions(t: Tables) -> DataFrame:
    return filters.suggestions(sessions(t), "channel", 3)


@R.query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-11 23:59:59.999'")
def flt7_time_window(t: Tables) -> DataFrame:
    lo, hi = tm.date_range("2024-01-10", "2024-01-11", None, None)
    return t.events.where(F.col("ts").between(F.lit(str(lo)).cast("timestamp_ntz"), F.lit(str(hi)).cast("timestamp_ntz"))).select("event_id")


@R.query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-29 22:00:00' ORDER BY ts DESC")
def flt8_active(t: Tables) -> DataFrame:
    return t.events.where(F.col("ts") >= F.lit("2024-01-29 22:00:00").cast("timestamp_ntz")).select("event_id", "ts").orderBy(F.desc("ts"))


@R.query("SELECT event_id FROM events WHERE event_type IN ('error', 'click') AND contains(lower(event_type || ' ' || user_id || ' ' || props), '\"k\": 1')")
def flt9_logs(t: Tables) -> DataFrame:
    d = t.events.select("event_id", F.col("event_type").alias("level"), F.col("event_type").alias("message"), F.col("user_id").cast("string").alias("subsystem"), F.col("props").alias("raw"))
    return filters.logs(d, ["error", "click"], ' "K": 1').select("event_id")


@R.query(f"WITH k AS ({KEYS}) SELECT event_id, CASE WHEN key LIKE 'agent:c%' THEN 'allow' WHEN event_id % 2 = 0 AND key LIKE 'agent:%' THEN 'deny' WHEN event_id % 2 = 0 THEN 'allow' ELSE 'deny' END AS action FROM k")
def flt11_scope_rules(t: Tables) -> DataFrame:
    d = session_keys(t).withColumn("even", (F.col("event_id") % 2 == 0).cast("string"))
    rules = [({"prefix": "agent:c"}, "allow"), ({"even": "true", "prefix": "agent:"}, "deny"), ({"even": "true"}, "allow")]
    return d.select("event_id", filters.first_rule(rules).alias("action"))


@R.query("SELECT user_id, event_id, ts, CASE WHEN ts < TIMESTAMP '2024-01-29 04:00:00' THEN 'daily' WHEN epoch_us(TIMESTAMP '2024-01-29 20:00:00') - epoch_us(ts) > 3600e6 * 10 THEN 'idle' ELSE 'fresh' END AS state FROM events")
def prj15_freshness(t: Tables) -> DataFrame:
    now, reset = F.lit("2024-01-29 20:00:00").cast("timestamp_ntz"), F.lit("2024-01-29 04:00:00").cast("timestamp_ntz")
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 36_000 * 1_000_000
    return t.events.select("user_id", "event_id", "ts", F.when(F.col("ts") < reset, "daily").when(idle, "idle").otherwise("fresh").alias("state"))


TIERS = "SELECT user_id, count(*) AS accesses, round(avg(value) / 50, 6) AS importance, max(ts) AS last FROM events GROUP BY 1"


@R.query(f"SELECT *, CASE WHEN importance >= 0.7 THEN 'hot' WHEN importance >= 0.4 THEN 'warm' ELSE 'cold' END AS initial, CASE WHEN importance >= 0.4 AND accesses >= 10 THEN 'hot' WHEN importance <= 0.3 AND accesses <= 2 THEN 'cold' ELSE 'warm' END AS optimal FROM ({TIERS})")
def prj12_tiers(t: Tables) -> DataFrame:
    d = t.events.groupBy("user_id").agg(F.count("*").alias("accesses"), F.round(F.avg("value") / 50, 6).alias("importance"), F.max("ts").alias("last"))
    i, a = F.col("importance"), F.col("accesses")
    return d.withColumns({"initial": F.when(i >= 0.7, "hot").when(i >= 0.4, "warm").otherwise("cold"), "optimal": F.when((i >= 0.4) & (a >= 10), "hot").when((i <= 0.3) & (a <= 2), "cold").otherwise("warm")})


@R.query("SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY last NULLS FIRST, user_id LIMIT 20")
def win10_lru(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.asc_nulls_first("last"), "user_id").limit(20)


@R.query("""SELECT n_nationkey, n_nationkey || ',' || CASE WHEN contains(n_name || ', "x"', ',') THEN '"' || replace(n_name || ', "x"', '"', '""') || '"' ELSE n_name END || ',' AS line FROM nation""")
def snk1_csv_lines(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", writers.csv_line([F.col("n_nationkey"), F.concat("n_name", F.lit(', "x"')), F.lit(None)]).alias("line"))


@R.query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 3")
def snk9_last_lines(t: Tables) -> DataFrame:
    return writers.last_lines(t.events, "user_id", "event_id", 3).select("user_id", "event_id")


@R.query("SELECT event_id FROM events WHERE epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-30') - 7 * 86400000000")
def snk10_fresh(t: Tables) -> DataFrame:
    return writers.fresh(t.events, "ts", F.lit("2024-01-30 00:00:00"), 7).select("event_id")


@R.query("WITH n AS (SELECT user_id, event_type, value + 1 AS value, event_id FROM events WHERE event_id % 10 = 0), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM n) WHERE r = 1), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1) SELECT user_id, event_type, value FROM l UNION ALL SELECT user_id, event_type, value FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM l)")
def snk4_upsert(t: Tables) -> DataFrame:
    latest = lambda d: writers.latest(d, ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "value")
    return writers.upserted(latest(t.events), latest(t.events.where("event_id % 10 = 0").withColumn("value", F.col("value") + 1)), ["user_id", "event_type"])


R.sql["snk4_upsert"] = R.sql["snk4_upsert"].replace("WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM l)", "ANTI JOIN l USING (user_id, event_type)")


@R.query("SELECT o_orderkey, o_custkey, CASE WHEN o_custkey <= 0 THEN NULL WHEN o_orderkey * 7 < 1000 THEN 1000 ELSE 1000 + greatest(1, ceil((o_orderkey * 7 - 1000) / nullif(o_custkey * 10, 0)), floor((o_orderkey * 7 - 1000) / nullif(o_custkey * 10, 0)) + 1)::BIGINT * o_custkey * 10 END AS next FROM orders")
def dt2_next_every(t: Tables) -> DataFrame:
    now = F.col("o_orderkey") * 7
    return t.orders.select("o_orderkey", "o_custkey", tm.next_every(now, F.col("o_custkey") * 10, F.lit(1000)).alias("next"))


@R.query("SELECT o_orderkey, CASE WHEN s <= 0 THEN 'now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h' || CASE WHEN floor(s / 60)::BIGINT % 60 > 0 THEN ' ' || floor(s / 60)::BIGINT % 60 || 'm' ELSE '' END ELSE floor(s / 86400)::BIGINT || 'd ' || floor(s / 3600)::BIGINT % 24 || 'h' END AS left FROM (SELECT o_orderkey, (o_orderkey - 1000) * 10 AS s FROM orders)")
def dt4_remaining(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tm.remaining((F.col("o_orderkey") - 1000) * 10).alias("left"))


@R.query("""WITH s AS (SELECT *, 'agent:main:cron:' || event_id AS key FROM events),
hits AS (SELECT event_id AS "sessionId", [contains(lower('agent' || user_id % 3), 'nt1'), contains(event_type, 'cl'), contains(CASE WHEN user_id % 2 = 0 THEN 'group' ELSE 'direct' END, 'rou'), contains(lower('Prov' || user_id % 5), 'ov3'), coalesce(contains(lower(CASE WHEN user_id % 7 > 0 THEN 'M' || user_id % 7 END), 'm4'), false),
    contains(lower('tool_' || event_type), 'l_vi'), regexp_matches(key, '(?i)^agent:.*7.$'), contains(event_id::VARCHAR, '99'), regexp_matches(event_id::VARCHAR, '^.5.$'), contains(lower('Label ' || user_id), 'bel 12'), event_type <> 'view', user_id % 4 > 0, value > 10, value IS NOT NULL, user_id % 7 > 0, true,
    value >= 20, value <= 5.5, value / 10 >= 1.5, user_id % 9 >= 3, user_id % 9 <= 2] AS h FROM s)
SELECT "sessionId", list_aggregate(list_transform(h, lambda x: CASE WHEN x THEN '1' ELSE '0' END), 'string_agg', '') AS found FROM hits""")
def flt2_every_key(t: Tables) -> DataFrame:
    """Every key of the filter language, each as a query of its own over all events as sessions."""
    u, kind = F.col("user_id"), F.col("event_type")
    name = lambda p, c: F.concat(F.lit(p), c)
    d = t.events.select(
        name("agent:main:cron:", F.col("event_id")).alias("key"), F.col("event_id").alias("sessionId"), name("Label ", u).alias("label"), name("agent", u % 3).alias("agentId"), kind.alias("channel"),
        F.when(u % 2 == 0, "group").otherwise("direct").alias("chatType"), name("Prov", u % 5).alias("modelProvider"), F.when(u % 7 > 0, name("M", u % 7)).alias("model"), F.array(name("tool_", kind)).alias("tools"),
        F.when(kind != "view", 1).otherwise(0).alias("toolCalls"), (u % 4).alias("errors"), F.when(F.col("value") > 10, 1).alias("contextTokens"), F.col("value").alias("totalTokens"), (F.col("value") / 10).alias("totalCost"), (u % 9).alias("messages"),
    )
    asked = ["agent:NT1", "channel:cl", "chat:rou", "provider:OV3", "model:m4", "tool:L_VI", "key:agent:*7?", "session:99", "id:?5?", '"label:bel 12"', "has:tools", "has:errors", "has:context", "has:usage", "has:model", "has:provider", "minTokens:20", "maxTokens:5.5", "minCost:$1.5", "minMessages:3", "maxMessages:2"]
    conditions = [F.when(F.coalesce(filters.parsed(q, d.columns).condition, F.lit(False)), "1").otherwise("0") for q in asked]
    return d.select("sessionId", F.concat(*conditions).alias("found"))
