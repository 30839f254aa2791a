"""Chunks, tags, keywords and records."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import chunks, detect, memory, tables
from larkspur.functions import text as T
from larkspur.functions import time as tm
from larkspur.operators import graph
from larkspur.plans.registry import Registry, Tables
from larkspur.sources import readers, writers

R = Registry()


@R.query()
def txt6_markdown_chunks(t: Tables) -> DataFrame:
    return chunks.markdown_chunks(t.documents, "doc_id", "text", 100, 20)


@R.query()
def txt8_byte_pieces(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(chunks.byte_pieces(F.col("text"), 1000)).alias("piece", "text"))


@R.query()
def txt9_message_pieces(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(chunks.message_pieces(F.col("text"), 500)).alias("piece", "text"))


@R.query()
def txt14_pii_spans(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(detect.detected(F.col("text"))).alias("p")).select("doc_id", "p.*")


@R.query()
def txt15_sanitised(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", detect.sanitised(F.col("text")).alias("text"))


@R.query()
def txt3_keywords(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.explode(memory.keyword_column(F.col("text"))).alias("keyword"))


@R.query()
def txt27_visible(t: Tables) -> DataFrame:
    said = F.concat(F.lit("<relevant-memories>x</relevant-memories>"), "text")
    return t.conversations.select("conv_id", "turn", memory.visible(said).alias("text"))


def _like(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


GIVEN = ", ".join(f"CASE WHEN {_like(words)} THEN '{n}' END" for words, names in memory.TAGS for n in names)
MOODS = ", ".join(f"CASE WHEN regexp_matches(l, '{p}') THEN '{n}' END" for p, n in memory.SENTIMENTS)


@R.query(f"""WITH c AS (SELECT conv_id, turn, role, lower(text) AS l FROM conversations WHERE text IS NOT NULL), a AS (SELECT conv_id, turn, list_filter(list_concat([role], [{GIVEN}], ['ab_c'], [{MOODS}]), lambda x: x IS NOT NULL) AS t FROM c),
u AS (SELECT conv_id, turn, unnest(t) AS tag, generate_subscripts(t, 1) AS i FROM a), d AS (SELECT conv_id, turn, tag, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS r, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM d)
SELECT conv_id, turn, tag, least(1.0::DOUBLE, n / 5) AS confidence FROM r WHERE r <= 10""")
def prj14_tags(t: Tables) -> DataFrame:
    d = t.conversations.where("text is not null").select("conv_id", "turn", memory.tags(F.col("text"), F.col("role"), F.array(F.lit("Ab C"), F.lit("xy"))).alias("g"))
    return d.select("conv_id", "turn", F.explode("g.tags").alias("tag"), "g.confidence")


@R.query("SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type IN ('error', 'signup'))")
def txt29_tag_search(t: Tables) -> DataFrame:
    d = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return memory.tagged(d, ["error", "signup"]).select("user_id")


@R.query("""SELECT conv_id, turn, concat_ws(',', CASE WHEN coalesce(length(text), 0) < 5 THEN 'content too short' END, CASE WHEN length(text) > 500 THEN 'content too long' END, CASE WHEN turn % 2 = 0 THEN 'category' END,
CASE WHEN turn / 3 > 1 THEN 'confidence' END, CASE WHEN turn % 5 = 1 THEN 'unknown source' END) AS errors FROM conversations""")
def jsn4_record_errors(t: Tables) -> DataFrame:
    turn = F.col("turn")
    sources = F.array(F.when(turn % 5 == 1, "m9").otherwise("m1"))
    e = memory.record_errors(F.col("text"), F.when(turn % 2 == 0, "Wrong").otherwise("User"), turn / 3, sources, F.array(F.lit("m1"), F.lit("m2")))
    return t.conversations.select("conv_id", "turn", F.array_join(e, ",").alias("errors"))


W = "list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g')), ' '))"
LONG = "length(trim(regexp_replace(lower({}), '[^a-z0-9_]+', ' ', 'g'))) > 5"


@R.query(f"""WITH m AS (SELECT conv_id AS session, turn AS msg_id, {W.format("text")} AS w, {LONG.format("text")} AS l FROM conversations WHERE role = 'assistant'), i AS (SELECT conv_id AS session, turn, {W.format("text")} AS w, {LONG.format("text")} AS l FROM conversations WHERE role <> 'system'),
n AS (SELECT m.session, msg_id, m.w AS a, i.w AS b, m.l AND i.l AS l, turn, max(turn) OVER (PARTITION BY m.session, msg_id) AS last FROM m JOIN i ON m.session = i.session AND msg_id - turn BETWEEN 0 AND 2),
g AS (SELECT session, msg_id, max((l AND len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) > 0.8)::INT)::DOUBLE AS overlap FROM n WHERE turn = last GROUP BY ALL)
SELECT session, msg_id, coalesce(overlap, 0) AS overlap, coalesce(overlap, 0) >= 0.75 AS is_recall FROM m LEFT JOIN g USING (session, msg_id)""")
def txt22_recalls(t: Tables) -> DataFrame:
    at = F.timestamp_seconds(F.col("turn") * 100)
    c = t.conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("msg_id"), at.alias("ts"), "role", F.col("text").alias("content"))
    return memory.recalls(c, c.where("role <> 'system'"), window_s=200)


NORM = r"trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'))"


@R.query("""WITH d AS (SELECT doc_id, trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS n FROM documents), b AS (SELECT DISTINCT trim(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS s FROM benchmark)
SELECT doc_id FROM d WHERE length(n) >= 10 AND EXISTS (SELECT 1 FROM b WHERE length(s) >= 10 AND (contains(n, s) OR contains(s, n)))""")
def jn16_contained(t: Tables) -> DataFrame:
    texts = t.documents.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return memory.already_sent(texts, t.benchmark).select(F.col("id").alias("doc_id"))


@R.query(f"""WITH x AS (SELECT conv_id * 1000 + turn AS id, text, {NORM} AS n FROM (SELECT conv_id, turn, substr(text, 5, 24) AS text FROM conversations)),
said AS (SELECT {NORM} AS s FROM conversations WHERE role = 'assistant' UNION SELECT {NORM} FROM (SELECT substr(text, 9, 12) AS text FROM conversations WHERE role = 'user')), b AS (SELECT s FROM said WHERE length(s) >= 10)
SELECT id, EXISTS (SELECT 1 FROM b WHERE contains(n, s)) AS holds, EXISTS (SELECT 1 FROM b WHERE contains(s, n)) AS held FROM x WHERE length(n) >= 10 AND EXISTS (SELECT 1 FROM b WHERE contains(n, s) OR contains(s, n))""")
def jn16_either(t: Tables) -> DataFrame:
    """Pieces of what was said, short ones, against whole turns and shorter pieces: held by them, holding them, or both."""
    piece = lambda a, n: F.substring("text", a, n).alias("text")
    texts = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), piece(5, 24))
    turns, shorter = t.conversations.where("role = 'assistant'").select("text"), t.conversations.where("role = 'user'").select(piece(9, 12))
    return memory.sent_ways(texts, turns.union(shorter))


@R.query("SELECT event_id, p, p IN ('MEMORY.md', './MEMORY.md') OR p LIKE 'memory/%' AS mem FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'MEMORY.md' WHEN 1 THEN './MEMORY.md' WHEN 2 THEN 'memory/x.md' ELSE 'notes/memory/x.md' END AS p FROM events)")
def flt12_memory_path(t: Tables) -> DataFrame:
    k = F.col("event_id") % 4
    p = F.when(k == 0, "MEMORY.md").when(k == 1, "./MEMORY.md").when(k == 2, "memory/x.md").otherwise("notes/memory/x.md")
    return t.events.select("event_id", p.alias("p")).withColumn("mem", memory.in_memory(F.col("p")))


@R.query("SELECT event_id, least(60000.0::DOUBLE, 500 * pow(2.0, greatest(event_id % 12 - 1, 0))) AS wait FROM events")
def mth3_backoff(t: Tables) -> DataFrame:
    return t.events.select("event_id", memory.backoff(F.col("event_id") % 12, 500, 2, 60_000).alias("wait"))


@R.query("SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k FROM events WHERE (props::JSON ->> '$.k')::BIGINT > 50")
def jsn1_json_field(t: Tables) -> DataFrame:
    d = t.events.select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")
    return d.where("k > 50")


@R.query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 30 OFFSET 10")
def rnk13_page(t: Tables) -> DataFrame:
    d = t.orders.orderBy(F.desc("o_totalprice"), F.asc_nulls_last("o_orderdate"), "o_orderkey")
    return d.offset(10).limit(30).select("o_orderkey", "o_totalprice", "o_orderdate")


@R.query("SELECT vec_id, round(CASE WHEN label IN (1, 2) THEN s * 1.5 ELSE s END, 6) AS score FROM (SELECT vec_id, label, embedding[2]::DOUBLE AS s FROM embeddings) WHERE CASE WHEN label IN (1, 2) THEN s * 1.5 ELSE s END >= 0.1 ORDER BY score DESC, vec_id LIMIT 10")
def rnk16_relationship_boost(t: Tables) -> DataFrame:
    s = F.col("embedding")[1].cast("double")
    d = t.embeddings.select("vec_id", F.when(F.col("label").isin(1, 2), s * 1.5).otherwise(s).alias("raw")).where("raw >= 0.1")
    return d.select("vec_id", F.round("raw", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@R.query("SELECT n_name AS name, coalesce(r.r_name, 'Unknown') AS type FROM nation LEFT JOIN region r ON n_regionkey = r_regionkey AND r_regionkey > 1")
def grf9_type_backfill(t: Tables) -> DataFrame:
    d = t.nation.join(t.region.where("r_regionkey > 1"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return d.select(F.col("n_name").alias("name"), F.coalesce("r_name", F.lit("Unknown")).alias("type"))


@R.query("""WITH d AS (SELECT l_orderkey AS id, 1.0::DOUBLE AS relevance FROM lineitem WHERE l_partkey = 7), x AS (SELECT DISTINCT b.l_orderkey AS id, 0.3::DOUBLE AS relevance FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey WHERE a.l_partkey = 7 AND b.l_quantity > 45)
SELECT id, max(relevance) AS relevance FROM (FROM d UNION ALL FROM x) GROUP BY 1""")
def grf3_direct_and_traversed(t: Tables) -> DataFrame:
    direct = t.lineitem.where("l_partkey = 7").select(F.col("l_orderkey").alias("id"), F.lit(1.0).alias("relevance"))
    suppliers = t.lineitem.where("l_partkey = 7").select("l_suppkey").distinct()
    traversed = t.lineitem.where("l_quantity > 45").join(suppliers, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("id"), F.lit(0.3).alias("relevance")).distinct()
    return direct.unionByName(traversed).groupBy("id").agg(F.max("relevance").alias("relevance"))


@R.query("SELECT src, string_agg(type || ' ' || dst, '; ' ORDER BY confidence DESC, dst) AS facts FROM (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type, o_totalprice AS confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'o' || o_orderkey) AS r FROM orders) WHERE r <= 5 GROUP BY src")
def grf10_top_facts(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    e = t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.lit("PLACED").alias("type"), F.col("o_totalprice").alias("confidence"))
    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    top = e.withColumn("r", F.row_number().over(w)).where("r <= 5")
    listed = F.array_sort(F.collect_list(F.struct("r", F.concat_ws(" ", "type", "dst").alias("fact"))))
    return top.groupBy("src").agg(F.array_join(F.transform(listed, lambda x: x["fact"]), "; ").alias("facts"))


@R.query("SELECT event_type AS name, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS alias, count(*) AS n FROM events GROUP BY ALL")
def snk6_alias_upsert(t: Tables) -> DataFrame:
    alias = F.when(F.col("user_id") % 2 == 0, "A").otherwise("b")
    d = t.events.groupBy(F.col("event_type").alias("name"), F.lower(alias).alias("alias")).agg(F.count("*").alias("n"))
    return d


@R.query("""SELECT user_id, '[Queue overflow] Dropped ' || count(*) || ' event' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' due to cap.' || chr(10) || string_agg('- error ' || event_id, chr(10) ORDER BY event_id) AS summary
FROM events WHERE event_type = 'error' GROUP BY user_id""")
def snk16_lines(t: Tables) -> DataFrame:
    dropped = t.events.where("event_type = 'error'").select("user_id", "event_id", F.concat(F.lit("error "), "event_id").alias("line"))
    return writers.overflow_summary(dropped, "user_id", "event_id", "event")


@R.query("SELECT source, to_json({'n': count(*), 'chars': sum(n_chars)::BIGINT}) AS report FROM documents GROUP BY 1")
def snk3_json_report(t: Tables) -> DataFrame:
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return g.select("source", F.to_json(F.struct("n", "chars")).alias("report"))


@R.query("SELECT event_id, ts FROM events WHERE ts::DATE >= DATE '2024-01-30' - 2")
def flt15_last_days(t: Tables) -> DataFrame:
    return t.events.where(F.to_date("ts") >= F.date_sub(F.lit("2024-01-30").cast("date"), 2)).select("event_id", "ts")




@R.query("SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 12))::BIGINT % 300000 AS stagger FROM orders")
def win12_stagger(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tm.stagger(F.col("o_orderkey").cast("string")).alias("stagger"))


@R.query("SELECT user_id, count(*) AS messages, round(sum(value), 6) AS cost, count(*) FILTER (event_type = 'error') AS errors, max(ts) AS recent FROM events GROUP BY 1 ORDER BY errors DESC, user_id LIMIT 50")
def rnk12_session_sort(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.count("*").alias("messages"), F.round(F.sum("value"), 6).alias("cost"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("recent"))
    return g.orderBy(F.desc("errors"), "user_id").limit(50)


@R.query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN make_timestamp(1704067200000000 + event_id * 1000) WHEN event_id % 3 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' END AS at FROM events")
def dt1_absolute_time(t: Tables) -> DataFrame:
    e = F.col("event_id")
    text = F.when(e % 3 == 0, (F.lit(1704067200000) + e).cast("string")).when(e % 3 == 1, "2024-01-05").otherwise("soon")
    return t.events.select("event_id", tm.absolute(text).cast("timestamp_ntz").alias("at"))


@R.query()
def snk8_compression(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", chunks.compression_ratio(F.col("text")).alias("ratio"))


@R.query("SELECT item_id, list_contains(list_distinct(regexp_extract_all(text, '\\b[A-Z][A-Za-z0-9]+\\b')), 'Than') AS than, regexp_matches(text, '(?i)\\b(i|me|my|mine|myself)\\b') AS me FROM benchmark")
def txt20_query_entities(t: Tables) -> DataFrame:
    b = t.benchmark.withColumn("e", memory.query_entities(F.col("text")))
    return b.select("item_id", F.array_contains("e", "Than").alias("than"), F.array_contains("e", "user").alias("me"))


@R.query("""WITH n AS (SELECT DISTINCT p_name || 's' AS name FROM part), k AS (SELECT DISTINCT p_name AS match FROM part), p AS (SELECT name, match, 1 - levenshtein(name, match) / greatest(length(name), length(match)) AS ratio FROM n, k),
b AS (SELECT name, match, ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, match) AS r FROM p WHERE ratio >= 0.8) WHERE r = 1)
SELECT name, coalesce(match, name) AS canonical, round(coalesce(ratio, 0.5), 6) AS confidence FROM n LEFT JOIN b USING (name)""")
def txt18_canonical(t: Tables) -> DataFrame:
    known = t.part.select(F.col("p_name").alias("name")).distinct()
    names = known.select(F.concat("name", F.lit("s")).alias("name"))
    d = names.join(graph.best_match(names, known), "name", "left")
    return d.select("name", F.coalesce("match", "name").alias("canonical"), F.round(F.coalesce("ratio", F.lit(0.5)), 6).alias("confidence"))


@R.query("SELECT conv_id, turn, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || chr(10) || '…(truncated)…' ELSE text END AS text, length(text) > 400 AS truncated FROM conversations")
def txt26_history_text(t: Tables) -> DataFrame:
    x = F.col("text")
    cut = F.when(F.length(x) > 400, F.concat(F.left(x, F.lit(400)), F.lit("\n…(truncated)…"))).otherwise(x)
    return t.conversations.select("conv_id", "turn", cut.alias("text"), (F.length(x) > 400).alias("truncated"))


@R.query("SELECT page_id, substr(html, 1, 1000) AS html, length(html) > 1000 AS truncated FROM pages")
def htm3_truncate(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.snippet(F.col("html"), 1000).alias("html"), T.truncated(F.col("html"), 1000).alias("truncated"))


def asked(t: Tables, query: str) -> DataFrame:
    """SQL with the table functions, over the documents as `said` (doc_id, text) and as the memories."""
    t.documents.select("doc_id", "text").createOrReplaceTempView("said")
    tables.register(t.spark, t.documents.select(F.col("doc_id").alias("id"), "text"), {"word": lambda window: window.rfind(" ")})
    return t.spark.sql(query)


@R.query("""SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, sha256(replace(text, chr(10), '')) AS kept, true AS hashed, true AS in_turn FROM documents WHERE text IS NOT NULL""")
def udf4_markdown_chunks(t: Tables) -> DataFrame:
    """What chunks without an overlap come to: every line of a text, in turn, each once, with the hash of its text."""
    return asked(t, """SELECT doc_id, max(end_line) AS lines, sha2(replace(array_join(transform(array_sort(collect_list(struct(chunk, chunk_text))), x -> x.chunk_text), ''), '\n', ''), 256) AS kept,
        bool_and(hash = sha2(chunk_text, 256)) AS hashed, bool_and(start_line <= 1 + coalesce(before, 0) AND start_line >= coalesce(before, 1)) AS in_turn
        FROM (SELECT *, lag(end_line) OVER (PARTITION BY doc_id ORDER BY chunk) AS before FROM markdown_chunks(TABLE(SELECT * FROM said), text => 'text', tokens => 100, overlap => 0)) GROUP BY doc_id""")


@R.query("""SELECT doc_id, sha256(regexp_replace(text, '[ \n\t]', '', 'g')) AS kept, true AS fits FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^ \n\t]')""")
def udf4_message_pieces(t: Tables) -> DataFrame:
    """What pieces that end with a sentence where one does come to: the text, without the spaces at the cuts."""
    return asked(t, """SELECT doc_id, sha2(regexp_replace(array_join(transform(array_sort(collect_list(struct(piece, piece_text))), x -> x.piece_text), ''), '[ \\n\\t]', ''), 256) AS kept,
        bool_and(char_length(piece_text) BETWEEN 1 AND 500) AS fits FROM message_pieces(TABLE(SELECT * FROM said), text => 'text', most => 500, at => 'sentence')
        WHERE piece_text rlike '[^ \\n\\t]' GROUP BY doc_id""")


@R.query("""SELECT doc_id, sha256(text) AS kept, true AS fits, greatest(1, ceil(strlen(text) / 1000))::INT <= strlen(text) // 997 + 1 AS few FROM documents WHERE text IS NOT NULL""")
def udf4_byte_pieces(t: Tables) -> DataFrame:
    """What pieces of 1000 bytes come to: the text, in as few pieces as characters of several bytes allow."""
    return asked(t, """SELECT doc_id, sha2(array_join(transform(array_sort(collect_list(struct(piece, piece_text))), x -> x.piece_text), ''), 256) AS kept, bool_and(octet_length(piece_text) <= 1000) AS fits,
        count(*) <= sum(octet_length(piece_text)) div 997 + 1 AS few FROM byte_pieces(TABLE(SELECT * FROM said), text => 'text', most => 1000) GROUP BY doc_id""")


@R.query("""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents), d AS (SELECT id, w, len(w) AS length FROM w WHERE len(w) > 0),
s AS (SELECT count(*) AS n, avg(length) AS mean FROM d), q AS (SELECT unnest(['the', 'casino', 'worthless', 'nation']) AS term),
tf AS (SELECT id, length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q), df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id ORDER BY score DESC, id LIMIT 25""")
def udf5_memory_search(t: Tables) -> DataFrame:
    return asked(t, "SELECT id, score FROM memory_search('The casino: worthless NATION', 25)")


@R.query("SELECT doc_id AS id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS text FROM documents WHERE doc_id IN (3, 17)")
def udf5_memory_get_sql(t: Tables) -> DataFrame:
    return asked(t, "SELECT * FROM memory_get(3, 2, 2) UNION ALL SELECT * FROM memory_get(17, 2, 2)")


@R.query(f"""WITH w AS (SELECT item_id, text, list_distinct(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '[A-Za-z0-9_]+')) AS ws FROM benchmark)
SELECT item_id, entity FROM (SELECT item_id, unnest(list_filter(ws, lambda x: regexp_full_match(x, '[A-Z][A-Za-z0-9]+') AND NOT list_contains({sorted(memory.STOP["en"])!r}, lower(x)))) AS entity FROM w
UNION ALL SELECT item_id, 'user' FROM w WHERE len(list_filter(ws, lambda x: lower(x) IN ('i', 'me', 'my', 'mine', 'myself'))) > 0)""")
def txt20_entities(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.explode(memory.query_entities(F.col("text"))).alias("entity"))


@R.query("""WITH b AS (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 2 WHEN turn % 3 = 1 THEN 1 ELSE 0 END AS calls FROM conversations)
SELECT conv_id, turn, CASE calls WHEN 2 THEN role || ',search' WHEN 1 THEN 'search' ELSE '' END AS names, calls FROM b JOIN conversations USING (conv_id, turn)""")
def jsn3_tool_names(t: Tables) -> DataFrame:
    """Messages as blocks: text, a call with and one without a name, a result, and plain text."""
    k = F.col("turn") % 3
    block = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.when(F.lit(kind) == "text", F.col("text")).alias("text"), name.cast("string").alias("name"))
    full = F.to_json(F.array(block("text", F.lit(None)), block("toolCall", F.col("role")), block("tool_result", F.lit("no")), block("tool_use", F.lit("search"))))
    some = F.to_json(F.array(block("text", F.lit(None)), block("toolUse", F.lit("search")), block("tool_call", F.lit(None))))
    d = t.conversations.select("conv_id", "turn", F.when(k == 0, full).when(k == 1, some).otherwise(F.col("text")).alias("content"))
    names = readers.tool_names(F.col("content"))
    return d.select("conv_id", "turn", F.array_join(names, ",").alias("names"), F.size(names).alias("calls"))


@R.query("SELECT doc_id, strlen(text) = 0 AS none, strlen(text) > 0 AS within FROM documents WHERE text IS NOT NULL")
def snk8_bounds(t: Tables) -> DataFrame:
    """Deflate writes at least a thousandth of a text, and at most five bytes for each stretch of 16,383 and eleven more than it."""
    d = t.documents.where("text is not null").select("doc_id", F.octet_length("text").alias("size"), chunks.compression_ratio(F.col("text")).alias("ratio"))
    most = F.col("size") + 5 * F.ceil(F.col("size") / 16_383) + 11
    return d.select("doc_id", F.col("ratio").isNull().alias("none"), F.coalesce((F.col("ratio") * F.col("size") <= most) & (F.col("ratio") >= 0.0009), F.lit(False)).alias("within"))
