"""Text and page functions over documents, pages and conversations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import html, redact
from larkspur.functions import text as T
from larkspur.plans.registry import Registry, Tables

R = Registry()


@R.query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))), ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def txt4_tokens(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.array_join(F.sort_array(T.ascii_tokens(F.col("text"))), " ").alias("tokens"))


@R.query(r"""SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: '"' || x || '"'), ' AND ') END AS query
FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM conversations)""")
def txt1_fts_query(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.fts_query(F.col("text")).alias("query"))


@R.query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[*^":()]') THEN text WHEN len(w) > 0 THEN array_to_string(list_transform(w, lambda x: '"' || x || '"'), ' AND ') END AS query
FROM (SELECT conv_id, turn, text, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS w FROM conversations)""")
def txt2_fts_query_plain(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.fts_query_plain(F.col("text")).alias("query"))


@R.query(r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2))), ' ') AS words FROM benchmark")
def txt5_long_words(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(F.sort_array(T.long_words(F.col("text"))), " ").alias("words"))


W = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"


@R.query(f"""WITH d AS (SELECT conv_id, turn, {W} AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM d a JOIN d b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 9) AS likeness FROM p""")
def set4_jaccard(t: Tables) -> DataFrame:
    d = t.conversations.select("conv_id", "turn", T.ascii_tokens(F.col("text")).alias("w"))
    p = d.alias("a").join(d.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return p.select("a.conv_id", "a.turn", F.round(T.jaccard(F.col("a.w"), F.col("b.w")), 9).alias("likeness"))


@R.query("SELECT doc_id, 'sha256:' || sha256(text) AS hash, 'sha256:' || sha256(text || 'salt') AS peppered FROM documents WHERE text IS NOT NULL")
def txt16_content_hash(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"), T.content_hash(F.col("text"), "salt").alias("peppered"))


@R.query("SELECT doc_id, substr(text, 1, 700) AS snippet, length(text) > 700 AS truncated, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def prj1_snippets(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.where("text is not null").select("doc_id", T.snippet(x, 700).alias("snippet"), T.truncated(x, 700).alias("truncated"), T.estimated_tokens(x).alias("tokens"))


@R.query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'docs/' || doc_id || '#L' || (doc_id + 1) ELSE 'docs/' || doc_id || '#L' || (doc_id + 1) || '-L' || (doc_id + doc_id % 3 + 1) END AS citation FROM documents")
def prj2_citations(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select("doc_id", T.citation(F.concat(F.lit("docs/"), d), d + 1, d + d % 3 + 1).alias("citation"))


@R.query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part FROM documents WHERE text IS NOT NULL")
def prj3_line_range(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.line_range(F.col("text"), 2, 3).alias("part"))


@R.query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents WHERE text IS NOT NULL")
def txt10_session_text(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.session_text(F.col("text")).alias("flat"))


@R.query(r"""WITH l AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN length(s) <= 160 THEN s ELSE rtrim(substr(s, 1, 159)) || '…' END AS line FROM l""")
def txt25_one_line(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", T.one_line(F.col("text")).alias("line"))


@R.query(r"SELECT doc_id, length(regexp_replace(text, '[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FEFF}\x{E0000}-\x{E007F}]', '', 'g')) AS n FROM documents WHERE text IS NOT NULL")
def htm6_strip_invisible(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.length(T.strip_invisible(F.col("text"))).cast("long").alias("n"))


@R.query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name)), '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{200D}]', '', 'g'), '\s+', ' ', 'g')) AS plain,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', '-', 'g'), '[^a-z0-9#@._+-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS slug FROM part""")
def txt23_names(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.comparable(F.col("p_name")).alias("plain"), T.hyphen_slug(F.col("p_name")).alias("slug"))


@R.query(r"""WITH f AS (SELECT page_id, list_filter(regexp_extract_all(regexp_replace(trim(html), '(?i)\[[^\]]*]\((https?://\S+?)\)', ' ', 'g'), '(?i)https?://\S+'), lambda x: NOT regexp_matches(x, '(?i)^https?://(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.0\.0\.0|\[?::1)')) AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM f), k AS (SELECT page_id, link, min(i) AS i FROM u GROUP BY ALL)
SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM k) WHERE r <= 3""")
def txt21_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(T.links(F.col("html"), 3)).alias("link"))


@R.query(r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ips,
regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS redacted FROM documents WHERE text IS NOT NULL""")
def txt15_pii_subset(t: Tables) -> DataFrame:
    email, ip = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
    x = F.col("text")
    return t.documents.where("text is not null").select("doc_id", F.regexp_count(x, F.lit(email)).cast("long").alias("emails"), F.regexp_count(x, F.lit(ip)).cast("long").alias("ips"), F.regexp_replace(x, email, "[EMAIL]").alias("redacted"))


@R.query()
def txt11_redacted(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", redact.redacted(F.col("text")).alias("text"))


@R.query()
def htm1_markdown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.markdown(F.col("html")).alias("m")).select("page_id", "m.text", "m.title")


VOID = ", ".join(f"'{x}'" for x in sorted(html.VOID))


@R.query(f"""WITH t AS (SELECT page_id, regexp_extract_all(html, '{html.TAG}', 1) AS a, regexp_extract_all(html, '{html.TAG}', 2) AS b FROM pages), u AS (SELECT page_id, unnest(a) AS n, unnest(b) AS s, generate_subscripts(a, 1) AS i FROM t),
d AS (SELECT page_id, i, CASE WHEN starts_with(n, '/') THEN -1 ELSE 1 END AS x FROM u WHERE s = '' AND ltrim(lower(n), '/') NOT IN ({VOID})), r AS (SELECT page_id, i, sum(x) OVER (PARTITION BY page_id ORDER BY i) AS s FROM d),
m AS (SELECT page_id, s - least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS v FROM r) SELECT page_id, greatest(0, coalesce(max(v), 0))::INT AS depth FROM pages LEFT JOIN m USING (page_id) GROUP BY page_id""")
def htm4_nesting(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.nesting(F.col("html")).alias("depth"))


@R.query()
def htm5_visible(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.without_hidden(F.col("html")).alias("html"))


def _visible_sql(x: str) -> str:
    for tag in html.DROPPED:
        x = f"regexp_replace({x}, '(?is)<{tag}.*?</{tag}>', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', ' ', 'g')"
    for name, c in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{c}')"
    return rf"trim(regexp_replace({x}, '[ \t\r\n]+', ' ', 'g'))"


@R.query(f"SELECT page_id, {_visible_sql('html')} AS text FROM pages")
def htm1_visible_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", html.visible_text(F.col("html")).alias("text"))


PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '(!\[[^\]]*\]\([^)]+\))|\[([^\]]+)\]\([^)]+\)|`([^`]+)`', '\2\3', 'g'), '^(?:#{1,6}[ \t]+|[ \t]*[-*+][ \t]+|[ \t]*[0-9]+\.[ \t]+)', ''), '[ \t]+$', ''), '[ \t]{2,}', ' ', 'g')"""


@R.query(rf"""WITH l AS (SELECT conv_id, turn, text, list_filter(string_split(replace(text, chr(13), ''), chr(10)), lambda l: NOT regexp_matches(l, '^[ \t]*```[^`]*$')) AS ls FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(array_to_string(list_transform(ls, lambda l: {PLAIN}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS plain FROM l""")
def htm2_markdown_to_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", html.plain_text(F.col("text")).alias("plain"))


@R.query("""WITH c AS (SELECT conv_id, turn, text, lower(text) AS l, (turn % 4)::INT AS m, CASE turn % 3 WHEN 0 THEN 'User' WHEN 1 THEN 'KnowledgeBase' ELSE 'Other' END AS category FROM conversations WHERE text IS NOT NULL),
s AS (SELECT *, greatest(0, 1 - (contains(l, 'maybe') OR contains(l, 'perhaps') OR contains(l, 'possibly') OR contains(l, 'might') OR contains(l, 'could be') OR contains(l, 'sort of') OR contains(l, 'kind of'))::INT * 0.2::DOUBLE - (length(text) > 200)::INT * 0.1::DOUBLE - suffix(text, '?')::INT * 0.3::DOUBLE) AS clarity,
CASE category WHEN 'User' THEN 0.9::DOUBLE WHEN 'KnowledgeBase' THEN 0.6 ELSE 0.5 END AS importance,
least(1, greatest(0, 0.5::DOUBLE + regexp_matches(text, '[0-9]')::INT * 0.2::DOUBLE + regexp_matches(text, '[A-Z][a-z]+')::INT * 0.15::DOUBLE + regexp_matches(text, '(?i)\\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|tomorrow|yesterday|today|[0-9]{1,2}[/-][0-9]{1,2})\\b')::INT * 0.15::DOUBLE - (length(text) < 20)::INT * 0.2::DOUBLE)) AS specificity,
CASE WHEN m >= 3 THEN 1.0::DOUBLE WHEN m = 2 THEN 0.9 WHEN m = 1 THEN 0.75 ELSE 0.5 END AS support FROM c),
f AS (SELECT conv_id, turn, floor((0.3::DOUBLE * clarity + 0.3::DOUBLE * importance + 0.25::DOUBLE * specificity + 0.15::DOUBLE * support) * 100 + 0.5) / 100 AS confidence FROM s)
SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM f""")
def prj11_confidence(t: Tables) -> DataFrame:
    k = F.col("turn") % 3
    c = t.conversations.where("text is not null").withColumn("category", F.when(k == 0, "User").when(k == 1, "KnowledgeBase").otherwise("Other"))
    d = c.select("conv_id", "turn", T.confidence(F.col("text"), F.col("category"), F.col("turn") % 4).alias("confidence"))
    return d.withColumn("tier", T.confidence_tier(F.col("confidence")))


@R.query(r"""WITH n AS (SELECT unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+(?:[ \t\n\r][A-Z][a-z]+)*\b'))) AS name, 'Person' AS type, 0.7::DOUBLE AS c FROM benchmark
UNION ALL SELECT unnest(list_distinct(regexp_extract_all(text, '(?i)\b(?:nation|casino)\b'))), 'Project/Technology', 0.9 FROM benchmark UNION ALL SELECT unnest(list_distinct(regexp_extract_all(text, '\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b'))), 'Date', 0.8 FROM benchmark)
SELECT type, name, max(c) AS confidence, count(*) AS n FROM n WHERE type <> 'Person' OR (length(name) > 2 AND name NOT IN ('The', 'And', 'For', 'With')) GROUP BY type, name""")
def txt19_entities(t: Tables) -> DataFrame:
    e = t.benchmark.select(F.explode(T.entities(F.col("text"), ["nation", "casino"])).alias("e")).select("e.*")
    return e.groupBy("type", "name").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


@R.query("SELECT p_partkey, p_name, p_type, round(CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1 ELSE 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END, 9) AS ratio FROM part")
def txt17_levenshtein(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_name", "p_type", F.round(T.levenshtein_ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


@R.query("SELECT doc_id, regexp_matches(lower(text), 'disgusting|trash|worthless|idiot|scum|moron') AS flagged FROM documents WHERE text IS NOT NULL")
def prj13_keyword_flag(t: Tables) -> DataFrame:
    words = ["disgusting", "trash", "worthless", "idiot", "scum", "moron"]
    return t.documents.where("text is not null").select("doc_id", F.lower("text").rlike("|".join(words)).alias("flagged"))
