"""Readers and functions of their own: noisy output, broken transcripts, batches of answers, log lines, offsets, own patterns."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import chunks, memory, redact
from larkspur.functions import text as T
from larkspur.functions import time as tm
from larkspur.functions import vectors as V
from larkspur.operators import retrieval
from larkspur.plans.registry import Registry, Tables
from larkspur.sources import readers

R = Registry()


@R.query("""SELECT event_id, 'd' || user_id AS docid, value AS score FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, 'second ]', 0.5 FROM events WHERE event_type = 'click'""")
def src13_noisy_json(t: Tables) -> DataFrame:
    """Hits in the output of a search that says other things before and after them, with brackets in texts; some find nothing."""
    hit = F.to_json(F.struct(F.concat(F.lit("d"), "user_id").alias("docid"), F.col("value").alias("score"), F.lit('a "quoted ]" [text').alias("snippet")))
    second = F.when(F.col("event_type") == "click", F.concat(F.lit(", "), F.to_json(F.struct(F.lit("second ]").alias("docid"), F.lit(0.5).alias("score"))))).otherwise("")
    raw = F.when(F.col("event_type") == "view", F.lit("warming up... no results [")).otherwise(F.concat(F.lit("loaded 3 models\n["), hit, second, F.lit("] done in [4] ms")))
    return t.events.select("event_id", F.explode(readers.json_hits(raw)).alias("h")).select("event_id", "h.docid", "h.score")


@R.query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line FROM conversations)
SELECT 'c' || conv_id AS path, line + 1 AS line FROM c WHERE conv_id % 3 > 0 AND turn % 4 <> 3 UNION ALL SELECT DISTINCT 'c' || conv_id, 1 FROM c WHERE conv_id % 3 > 0""")
def src14_repaired(t: Tables) -> DataFrame:
    """Transcripts with lines that were cut off; those that do not begin with a session's header are no transcripts."""
    c = t.conversations.withColumn("line", F.row_number().over(_by_turn()) + 1)
    whole = F.to_json(F.struct(F.lit("message").alias("type"), F.col("text").alias("content")))
    said = c.select(F.concat(F.lit("c"), "conv_id").alias("path"), "line", F.when(F.col("turn") % 4 == 3, F.left(whole, F.lit(9))).otherwise(whole).alias("value"))
    head = t.conversations.select("conv_id").distinct().select(F.concat(F.lit("c"), "conv_id").alias("path"), F.lit(1).alias("line"), F.when(F.col("conv_id") % 3 > 0, '{"type":"session"}').otherwise('{"type":"message"}').alias("value"))
    return readers.repaired(said.unionByName(head)).select("path", F.col("line").cast("long").alias("line"))


def _by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


@R.query("""SELECT 'r' || o_orderkey AS custom_id, CASE WHEN o_orderkey % 5 IN (0, 1) THEN round(o_totalprice, 6) END AS first,
CASE o_orderkey % 5 WHEN 2 THEN 'missing' WHEN 3 THEN 'rate limited' WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'status 500' ELSE 'empty' END END AS error FROM orders""")
def src16_batch_output(t: Tables) -> DataFrame:
    """Requests of a batch beside what came back: vectors, messages, bad states, nothing in them, nothing at all."""
    k = F.col("o_orderkey")
    requests = t.orders.select(F.concat(F.lit("r"), k).alias("custom_id"))
    vector = F.when(k % 5 < 2, F.array(F.col("o_totalprice").cast("double"))).otherwise(F.array().cast("array<double>"))
    status = F.when((k % 5 == 4) & (k % 2 == 0), 500).otherwise(200)
    outputs = t.orders.where(k % 5 != 2).select(F.concat(F.lit("r"), k).alias("custom_id"), vector.alias("embedding"), F.when(k % 5 == 3, "rate limited").alias("message"), status.alias("status"))
    return readers.batch_output(requests, outputs).select("custom_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), "error")


@R.query("SELECT event_type AS folder, 'log-' || event_id AS path FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, 'log-' || event_id DESC) AS r FROM events) WHERE r = 1")
def src8_latest_log(t: Tables) -> DataFrame:
    """The log of each kind that was changed last."""
    kinds = sorted(r[0] for r in t.events.select("event_type").distinct().collect())  # a few kinds
    files = t.events.select("event_type", F.concat(F.lit("log-"), "event_id").alias("path"), F.col("ts").alias("mtime"))
    return t.spark.createDataFrame([(k, readers.latest_log(files.where(F.col("event_type") == k))) for k in kinds], "folder string, path string")


@R.query("SELECT event_id, '2024-01-01T00:00:' || lpad((user_id % 60)::VARCHAR, 2, '0') AS time, lower(event_type) AS level, 'sub' || user_id % 7 AS subsystem, 'took ' || value || ' ms' AS message FROM events WHERE user_id % 11 > 0 UNION ALL SELECT event_id, NULL, NULL, NULL, '' FROM events WHERE user_id % 11 = 0")
def jsn2_log_lines(t: Tables) -> DataFrame:
    """Lines of a log whose parts are numbered and whose names are JSON in JSON; some lines are no JSON."""
    name = F.to_json(F.struct(F.concat(F.lit("sub"), F.col("user_id") % 7).alias("subsystem")))
    meta = F.to_json(F.struct(F.upper("event_type").alias("logLevelName"), name.alias("name")))
    line = F.to_json(F.struct(F.concat(F.col("value").cast("string"), F.lit(" ms")).alias("1"), F.lit("took").alias("0"), meta.alias("_meta"), F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("user_id") % 60).cast("string"), 2, "0")).alias("time")))
    raw = t.events.select(F.to_json(F.struct("event_id")).alias("id"), F.when(F.col("user_id") % 11 > 0, line).otherwise("boot").alias("line"), "event_id")
    # what the reader returns has the raw line, by which an event is found again
    keyed = raw.select("event_id", F.when(F.col("line") == "boot", F.concat(F.lit("boot "), "event_id")).otherwise(F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(',"zz":"'), "event_id", F.lit('"}'))).alias("value"))
    d = readers.log_lines(keyed)
    found = F.coalesce(F.get_json_object("raw", "$.zz"), F.regexp_extract("raw", "([0-9]+)$", 1))
    return d.select(found.cast("long").alias("event_id"), "time", "level", "subsystem", "message")


@R.query("SELECT doc_id, doc_id * 10 + 1 AS start_line, CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 + 3 ELSE 3 END AS end_line FROM documents")
def txt7_remapped(t: Tables) -> DataFrame:
    """Lines of chunks as the source's; a map that is too short leaves them."""
    source = lambda k: (F.col("doc_id") * 10 + k).cast("int")
    d = t.documents.select("doc_id", F.lit(1).alias("start_line"), F.lit(3).alias("end_line"), F.when(F.col("doc_id") % 2 == 0, F.array(source(1), source(2), source(3))).otherwise(F.array(source(1))).alias("lines"))
    return chunks.remapped(d, F.col("lines")).select("doc_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@R.query("SELECT event_id, user_id, event_type AS kind FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_type = 'view'")
def txt28_clean_json(t: Tables) -> DataFrame:
    """What a model answers: JSON between fences and words, sometimes only words."""
    body = F.to_json(F.struct("user_id", F.struct(F.col("event_type").alias("kind")).alias("x")))
    raw = F.when(F.col("event_type") == "view", "I cannot do that.").otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nAnything else?")))
    d = t.events.select("event_id", memory.clean_json(raw).alias("j"))
    return d.select("event_id", F.get_json_object("j", "$.user_id").cast("long").alias("user_id"), F.get_json_object("j", "$.x.kind").alias("kind"))


@R.query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z]{6})[a-z]{8,}([a-z]{4})', '\1…\2', 'g'), '(ref|no)=[0-9]{1,17}', '\1=***', 'g') AS text FROM (SELECT doc_id, text || ' ref=' || doc_id || ' no=77' AS text FROM documents)")
def udf1_own_patterns(t: Tables) -> DataFrame:
    """A caller's patterns, with flags or without; one that repeats a repetition is not taken."""
    text = F.concat("text", F.lit(" ref="), "doc_id", F.lit(" no=77"))
    masked = redact.redacted(text, ["/[a-z]{18,}/g", r"(?:ref|no)=([0-9]{1,17})", "(a+)+$", "["])
    return t.documents.select("doc_id", masked.alias("text"))


@R.query("""WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[ \\n\\t]+'), lambda x: x <> '') AS w FROM documents), d AS (SELECT id, w, len(w) AS length FROM w WHERE len(w) > 0),
s AS (SELECT count(*) AS n, avg(length) AS mean FROM d), q AS (SELECT unnest(['the', 'casino,', 'nation.']) AS term), tf AS (SELECT id, length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term),
b AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id)
SELECT id, round(1 / (1 + greatest(20 - score, 0)), 6) AS score FROM b ORDER BY 2 DESC, id LIMIT 30""")
def udf3_own_words_and_rank(t: Tables) -> DataFrame:
    """A search by words as the caller cuts them, punctuation and all, with scores as the caller wants them."""
    own = lambda text: F.filter(F.split(F.lower(text), r"[ \n\t]+"), lambda x: x != "")
    return retrieval.bm25(t.documents, "doc_id", "text", ["the", "casino,", "nation."], 30, words=own, rank=lambda s: V.rank_score(20 - s))


@R.query("""WITH o AS (SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'UTC+5:30' WHEN 1 THEN ' utc-4 ' WHEN 2 THEN 'UTC+14' WHEN 3 THEN 'UTC+14:30' WHEN 4 THEN 'GMT+5' END AS said, CASE user_id % 6 WHEN 0 THEN 330 WHEN 1 THEN -240 WHEN 2 THEN 840 END AS minutes FROM events)
SELECT event_id, minutes, CASE minutes WHEN 330 THEN 'UTC+5:30' WHEN -240 THEN 'UTC-4' WHEN 840 THEN 'UTC+14' END AS again FROM o""")
def dt5_offsets(t: Tables) -> DataFrame:
    d = t.events.select("event_id", tm.offset_minutes(_said_offset()).alias("minutes"))
    return d.select("event_id", "minutes", tm.offset_text(F.col("minutes")).alias("again"))


def _said_offset():
    k = F.col("user_id") % 6
    return F.when(k == 0, "UTC+5:30").when(k == 1, " utc-4 ").when(k == 2, "UTC+14").when(k == 3, "UTC+14:30").when(k == 4, "GMT+5")


@R.query("""WITH o AS (SELECT event_id, ts, CASE user_id % 6 WHEN 0 THEN 330 WHEN 1 THEN -240 WHEN 2 THEN 840 ELSE 0 END AS minutes FROM events)
SELECT event_id FROM o WHERE (ts + to_minutes(minutes))::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'""")
def flt14_dates_at_offsets(t: Tables) -> DataFrame:
    """Events on some dates as each user's own offset has them; one that cannot be read counts as none."""
    return t.events.where(tm.in_dates(F.col("ts"), F.lit("2024-01-10"), F.lit("2024-01-12"), _said_offset())).select("event_id")


@R.query("SELECT doc_id, sum(ceil(length(t) / 4))::BIGINT AS tokens, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY doc_id")
def agg26_estimated_tokens(t: Tables) -> DataFrame:
    """Tokens of each line of a text by a quarter of its characters, and of all of them."""
    d = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.groupBy("doc_id").agg(F.sum(T.estimated_tokens(F.col("line"))).alias("tokens"), F.count("*").alias("lines"))
