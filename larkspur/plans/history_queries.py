"""Conversation histories."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import history
from larkspur.plans.registry import Registry, Tables

R = Registry()


@R.query("""WITH u AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k, sum((role = 'user')::INT) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, role FROM u WHERE n < 2 OR k < 2 OR (k = 2 AND role = 'user')""")
def win2_last_user_turns(t: Tables) -> DataFrame:
    return history.last_user_turns(t.conversations, 2).select("conv_id", "turn", "role")


@R.query("""WITH c AS (SELECT *, coalesce(lag(role) OVER w <> role, true)::INT AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT conv_id, island::BIGINT AS island, role, min(turn) AS first_turn, count(*) AS n, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, island, role""")
def win3_merge_turns(t: Tables) -> DataFrame:
    return history.merged_turns(t.conversations)


@R.query("SELECT conv_id, turn, used::BIGINT AS used FROM (SELECT conv_id, turn, sum(ceil(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 300")
def win4_prune_budget(t: Tables) -> DataFrame:
    return history.newest_within(t.conversations, T.estimated_tokens(F.col("text")), 300).select("conv_id", "turn", F.col("used").cast("long").alias("used"))


@R.query("""WITH s AS (SELECT conv_id, turn, ceil(length(text) / 4) AS t FROM conversations), b AS (SELECT conv_id, turn, coalesce(sum(t) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(t) OVER (PARTITION BY conv_id) AS a FROM s)
SELECT conv_id, turn, least(2, floor(CASE WHEN a > 0 THEN b * 3 / a ELSE 0 END)::INT) AS part FROM b""")
def win4_split_parts(t: Tables) -> DataFrame:
    return history.token_parts(t.conversations, T.estimated_tokens(F.col("text")), 3).select("conv_id", "turn", "part")


@R.query("""WITH s AS (SELECT conv_id, turn, text, strlen(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS last, sum(strlen(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, turn, text FROM s WHERE used <= 900 UNION ALL SELECT conv_id, turn, '[omitted: message too large]' FROM s WHERE last = 1 AND size > 900""")
def win7_byte_cap(t: Tables) -> DataFrame:
    return history.newest_bytes(t.conversations, 900).select("conv_id", "turn", "text")


@R.query("SELECT text, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def win8_keep_first(t: Tables) -> DataFrame:
    return history.first_of_each(t.documents, "text", "doc_id").select("text", "doc_id")


@R.query("""WITH s AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) >= 3 AS old FROM conversations)
SELECT conv_id, turn, CASE WHEN old AND role = 'user' AND length(text) > 200 THEN substr(text, 1, 80) || chr(10) || '...' || chr(10) || right(text, 40) ELSE text END AS text FROM s""")
def win13_prune_results(t: Tables) -> DataFrame:
    return history.pruned_results(t.conversations, "user", 3, 200, 80, 40).select("conv_id", "turn", "text")


@R.query("SELECT conv_id, turn FROM conversations c WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id * 10 + c.turn AND d.lang = 'en')")
def jn12_without_orphans(t: Tables) -> DataFrame:
    results = t.conversations.withColumn("call_id", F.col("conv_id") * 10 + F.col("turn"))
    return history.without_orphans(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("call_id")), results).select("conv_id", "turn")


@R.query("""WITH c AS (SELECT conv_id, turn, role, 'k' || turn % 3 AS call, lead(role) OVER w AS nr, lead(turn) OVER w % 2 AS na FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN nr = 'user' AND turn % 3 = na THEN call ELSE '' END AS calls FROM c WHERE role = 'assistant'""")
def jn11_answered_calls(t: Tables) -> DataFrame:
    call = lambda c: F.array(F.concat(F.lit("k"), c))
    d = t.conversations.withColumns({"calls": call(F.col("turn") % 3), "answers": call(F.col("turn") % 2)})
    return history.answered_calls(d).where("role = 'assistant'").select("conv_id", "turn", F.array_join("calls", ",").alias("calls"))
