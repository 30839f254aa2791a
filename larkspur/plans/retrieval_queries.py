"""Retrieval over documents, embeddings and events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as V
from larkspur.operators import dedupe, retrieval, textindex
from larkspur.plans.registry import Registry, Tables
from larkspur.scratch import scratch_path

R = Registry()
NOW = "2024-02-01 00:00:00"
TERMS = ["the", "disgusting", "casino", "worthless", "nation"]


def first_vector(t: Tables) -> list[float]:
    """The query vector: row 0's."""
    return t.embeddings.where("vec_id = 0").select("embedding").head()[0]


COSINE = """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10"""


@R.query(COSINE)
def rnk1_cosine_topk(t: Tables) -> DataFrame:
    return retrieval.cosine_topk(t.embeddings, first_vector(t), 10)


@R.query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id < 32)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def rnk1_cosine_topk_many(t: Tables) -> DataFrame:
    queries = [(r.vec_id, list(r.embedding)) for r in t.embeddings.where("vec_id < 32").select("vec_id", "embedding").collect()]
    return retrieval.cosine_topk_many(t.embeddings, queries, 10)


@R.query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), j AS (SELECT v.vec_id, v.label, v.embedding FROM embeddings v WHERE v.label IN (1, 2, 3))
SELECT vec_id, label, round(1 - (1 - list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[])) / 2, 6) AS score FROM j, q ORDER BY score DESC, vec_id LIMIT 20""")
def rnk2_filtered_topk_half(t: Tables) -> DataFrame:
    return retrieval.cosine_topk(t.embeddings.where(F.col("label").isin(1, 2, 3)), first_vector(t), 20, mode="half")


@R.query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, generate_subscripts(e, 1) - 1 AS pos, round(unnest(e) / n, 6) AS x FROM n""")
def mth2_l2_normalise(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode(V.normalise(F.col("embedding"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


BM25 = f"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents),
d AS (SELECT id, w, len(w) AS length FROM w WHERE len(w) > 0),
s AS (SELECT count(*) AS n, avg(length) AS mean FROM d),
q AS (SELECT unnest([{", ".join(f"'{w}'" for w in TERMS)}]) AS term),
tf AS (SELECT id, length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q),
df AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY term)
SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score
FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY id"""


@R.query(BM25 + " ORDER BY score DESC, id LIMIT 50")
def rnk3_bm25_topk(t: Tables) -> DataFrame:
    return retrieval.bm25(t.documents, "doc_id", "text", TERMS, 50)


def fts(text):
    return T.fts_tokens(F.lower(text))


def benchmark_queries(t: Tables) -> DataFrame:
    """query_id, match: of each passage, its first two different words with AND, and its first five with OR."""
    first = lambda n: T.fts_query(F.array_join(F.slice(F.array_distinct(fts(F.col("text"))), 1, n), " "))
    both = [t.benchmark.select((F.col("item_id") * 2).alias("query_id"), first(2).alias("match")), t.benchmark.select((F.col("item_id") * 2 + 1).alias("query_id"), F.replace(first(5), F.lit(" AND "), F.lit(" OR ")).alias("match"))]
    return both[0].unionByName(both[1])


#: The rows of searches of a table `said` (id, text) with the benchmark's queries: every text is scored for every query.
SEARCHED = """listed AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM said),
word AS (SELECT id, len(w) AS length, unnest(w) AS term FROM listed), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM listed WHERE len(w) > 0),
tf AS (SELECT id, length, term, count(*) AS tf FROM word GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
d AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(i)) AS place FROM (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM q) GROUP BY item_id, term),
asked AS (SELECT item_id * 2 AS query_id, term, true AS every FROM d WHERE place <= 2 UNION ALL SELECT item_id * 2 + 1, term, false FROM d WHERE place <= 5),
wanted AS (SELECT query_id, count(*) AS wanted FROM asked GROUP BY query_id),
hit AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score, any_value(every) AS every, count(*) AS met
    FROM asked JOIN tf USING (term) JOIN df USING (term), s GROUP BY query_id, id)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM hit JOIN wanted USING (query_id) WHERE NOT every OR met = wanted) WHERE r <= 5"""


@R.query("WITH said AS (SELECT doc_id AS id, text FROM documents), " + SEARCHED)
def rnk3_index_batch(t: Tables) -> DataFrame:
    """All passages' queries at once, from a stored index of all documents."""
    path = scratch_path(t.spark, "index")
    textindex.add(t.documents, path, "doc_id", "text", fts)
    return textindex.search(t.spark, path, textindex.parsed(benchmark_queries(t)), 5)


@R.query("""WITH said AS (SELECT d.doc_id AS id, coalesce(c.text, d.text) AS text FROM documents d LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) c ON d.doc_id = c.conv_id
WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), """ + SEARCHED)
def rnk3_index_changed(t: Tables) -> DataFrame:
    """The same after some documents have come anew with other texts and some were deleted: three segments, not merged."""
    path = scratch_path(t.spark, "index")
    textindex.add(t.documents, path, "doc_id", "text", fts)
    first = t.conversations.where("turn = 0").select("conv_id", "text").join(t.documents.select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi")
    textindex.add(first, path, "conv_id", "text", fts)
    textindex.delete(t.labels.where("toxic = 1").select("doc_id"), path)
    return textindex.search(t.spark, path, textindex.parsed(benchmark_queries(t)), 5)


def both_lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = retrieval.cosine_topk(t.embeddings, first_vector(t), 40).select(F.col("vec_id").alias("id"), F.col("score").alias("vector_score"))
    k = retrieval.bm25(t.documents, "doc_id", "text", TERMS, 40).select("id", F.round(V.rank_score(10 - F.col("score")), 6).alias("text_score"))
    return v, k


LISTS = f"""WITH v AS (SELECT vec_id AS id, score AS vector_score FROM ({COSINE.replace("LIMIT 10", "LIMIT 40")})),
k AS (SELECT id, round(1 / (1 + greatest(10 - score, 0)), 6) AS text_score FROM ({BM25} ORDER BY score DESC, id LIMIT 40))"""
MERGED = LISTS + ", m AS (SELECT coalesce(v.id, k.id) AS id, coalesce(vector_score, 0) AS vector_score, coalesce(text_score, 0) AS text_score FROM v FULL JOIN k ON v.id = k.id)"


@R.query(MERGED + " SELECT id, vector_score, text_score, round(0.7 * vector_score + 0.3 * text_score, 6) AS score FROM m")
def jn2_hybrid_merge(t: Tables) -> DataFrame:
    return retrieval.merge_hits(*both_lists(t)).withColumn("score", F.round("score", 6))


@R.query(MERGED + " SELECT id, round(0.5 * vector_score + 0.5 * text_score, 6) AS score FROM m ORDER BY score DESC, id LIMIT 20")
def rnk4_hybrid_search(t: Tables) -> DataFrame:
    merged = retrieval.merge_hits(*both_lists(t), 0.5, 0.5).select("id", F.round("score", 6).alias("score"))
    return merged.orderBy(F.desc("score"), "id").limit(20)


@R.query(LISTS + """, b AS (SELECT id, vector_score AS score, 1 AS stage FROM v UNION ALL SELECT id, text_score, 2 FROM k)
SELECT id, score, stage FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, stage DESC) AS r FROM b) WHERE r = 1""")
def jn3_keep_higher(t: Tables) -> DataFrame:
    v, k = both_lists(t)
    return retrieval.keep_higher(v.withColumnRenamed("vector_score", "score"), k.withColumnRenamed("text_score", "score"))


@R.query(LISTS + " SELECT id, vector_score FROM v WHERE id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def jn4_semi_join(t: Tables) -> DataFrame:
    v, _ = both_lists(t)
    return v.join(t.documents.where("lang = 'en'").select(F.col("doc_id").alias("id")), "id", "left_semi")


@R.query("SELECT e.vec_id, e.label, d.lang FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.source = 'src1'")
def jn1_vectors_with_chunks(t: Tables) -> DataFrame:
    return t.embeddings.join(t.documents.where("source = 'src1'"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "label", "lang")


@R.query(f"SELECT event_id, round(value * exp(-ln(2.0) / 30 * greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6)), 6) AS score FROM events")
def rnk5_temporal_decay(t: Tables) -> DataFrame:
    hits = t.events.select("event_id", F.col("value").alias("score"), "ts")
    return retrieval.decayed(hits, "ts", F.lit(NOW)).select("event_id", F.round("score", 6).alias("score"))


@R.query("""WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'memory/2024-01-' || lpad((event_id % 35)::VARCHAR, 2, '0') || '.md' WHEN 1 THEN 'MEMORY.md' WHEN 2 THEN './memory/topic.md' ELSE 'notes/x.md' END AS path FROM events)
SELECT event_id, path, strftime(try_cast(nullif(regexp_extract(path, '(?:^|/)memory/([0-9]{4}-[0-9]{2}-[0-9]{2})\\.md$', 1), '') AS DATE), '%Y-%m-%d') AS day, path = 'MEMORY.md' OR path = './memory/topic.md' AS evergreen FROM p""")
def rnk6_path_dates(t: Tables) -> DataFrame:
    day = F.lpad((F.col("event_id") % 35).cast("string"), 2, "0")
    k = F.col("event_id") % 4
    path = F.when(k == 0, F.concat(F.lit("memory/2024-01-"), day, F.lit(".md"))).when(k == 1, "MEMORY.md").when(k == 2, "./memory/topic.md").otherwise("notes/x.md")
    return t.events.select("event_id", path.alias("path")).select("event_id", "path", F.date_format(V.path_date(F.col("path")), "yyyy-MM-dd").alias("day"), V.evergreen(F.col("path")).alias("evergreen"))


@R.query()
def rnk7_mmr(t: Tables) -> DataFrame:
    hits = retrieval.bm25(t.documents, "doc_id", "text", TERMS, 30).transform(lambda h: t.documents.select(F.col("doc_id").alias("id"), "text", "lang").join(F.broadcast(h), "id"))  # k rows
    return retrieval.mmr(hits, "lang", 0.7)


@R.query("""SELECT doc_id, round(least(0.5 + least(0.1 * ((contains(lower(text), 'disgusting'))::INT + (contains(lower(text), 'trash'))::INT + (contains(lower(text), 'the'))::INT + (contains(lower(text), 'scum'))::INT), 0.3), 1.0), 6) AS score FROM documents WHERE text IS NOT NULL""")
def rnk8_relevance_boost(t: Tables) -> DataFrame:
    hits = t.documents.where("text is not null").select("doc_id", F.lit(0.5).alias("score"), F.col("text").alias("content"))
    return retrieval.boosted(hits, "Disgusting trash of the scum").select("doc_id", F.round("score", 6).alias("score"))


LEXICAL = """SELECT doc_id, round(CASE WHEN contains(l, 'worthless trash nation') THEN 0.95 WHEN s >= 0.5 THEN least(s + 0.3, 0.9) ELSE s * 0.7 END, 6) AS score
FROM (SELECT doc_id, lower(text) AS l, (contains(lower(text), 'worthless')::INT + contains(lower(text), 'trash')::INT + contains(lower(text), 'nation')::INT) / 3 AS s FROM documents WHERE text IS NOT NULL)"""


@R.query(f"SELECT doc_id, score FROM ({LEXICAL}) WHERE score > 0.1 ORDER BY score DESC, doc_id LIMIT 50")
def rnk9_lexical_search(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").select("doc_id", F.round(retrieval.lexical(F.col("text"), "worthless trash nation"), 6).alias("score"))
    return d.where("score > 0.1").orderBy(F.desc("score"), "doc_id").limit(50)


@R.query("SELECT label, vec_id, place FROM (SELECT label, vec_id, score, row_number() OVER w AS place, count(*) OVER (PARTITION BY label) AS n FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY score DESC, vec_id)) WHERE place <= greatest(1, ceil(round(n * 0.3, 6))) AND score >= 0.1 AND place <= 10")
def win9_percent_cut(t: Tables) -> DataFrame:
    hits = t.embeddings.select("label", F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("score"))
    return retrieval.cut(hits, "label", "focused", threshold=0.1).select("label", F.col("id").alias("vec_id"), "place")


@R.query("""WITH d AS (SELECT source, doc_id, n_chars, text, sum(ceil(length(text) / 4)) OVER (PARTITION BY source ORDER BY doc_id * 7919 % 1000 DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents WHERE text IS NOT NULL)
SELECT source, doc_id, used::BIGINT AS used FROM d WHERE used <= 4000""")
def win5_pack_budget(t: Tables) -> DataFrame:
    hits = t.documents.where("text is not null").select("source", F.col("doc_id").alias("id"), (F.col("doc_id") * 7919 % 1000).alias("score"), F.col("text").alias("content"))
    return retrieval.packed(hits, "source", 4000).select("source", F.col("id").alias("doc_id"), F.col("used").cast("long").alias("used"))


@R.query("""WITH s AS (SELECT source, doc_id, substr(text, 1, 300) AS snippet, n_chars FROM documents WHERE text IS NOT NULL),
r AS (SELECT *, 1000 - coalesce(sum(length(snippet)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s)
SELECT source, doc_id, substr(snippet, 1, room::INT) AS snippet FROM r WHERE room > 0""")
def win6_char_clamp(t: Tables) -> DataFrame:
    hits = t.documents.where("text is not null").select("source", F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), T.snippet(F.col("text"), 300).alias("snippet"))
    return retrieval.clamped(hits, "source", 1000).select("source", F.col("id").alias("doc_id"), "snippet")


@R.query()
def ctx_dedupe_greedy(t: Tables) -> DataFrame:
    hits = retrieval.bm25(t.documents, "doc_id", "text", TERMS, 50).transform(lambda h: t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang").join(F.broadcast(h), "id"))  # k rows
    return dedupe.greedy(hits.withColumn("ts", F.col("id")), "lang")


TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"


@R.query(f"""WITH d AS (SELECT doc_id AS l_id, {TOKENS} AS w FROM documents), b AS (SELECT item_id AS r_id, {TOKENS} AS w FROM benchmark),
p AS (SELECT l_id, r_id, len(list_intersect(d.w, b.w)) AS i, len(d.w) AS x, len(b.w) AS y FROM d, b WHERE len(d.w) > 0 AND len(b.w) > 0 AND len(d.w) >= 0.5 * len(b.w) AND len(b.w) >= 0.5 * len(d.w))
SELECT l_id, r_id, round(i / (x + y - i), 6) AS similarity FROM p WHERE i / (x + y - i) >= 0.5""")
def jn8_similarity_join(t: Tables) -> DataFrame:
    left, right = t.documents.select(F.col("doc_id").alias("id"), "text"), t.benchmark.select(F.col("item_id").alias("id"), "text")
    return dedupe.similar_pairs(left, right, T.ascii_tokens(F.col("text")), 0.5).withColumn("similarity", F.round("similarity", 6))


@R.query("SELECT 'sha256:' || sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def txt16_exact_groups(t: Tables) -> DataFrame:
    return dedupe.exact_groups(t.documents, "doc_id", "text")


@R.query("SELECT source, count(*) AS n, count(DISTINCT text) AS uniq, round((count(*) - count(DISTINCT text)) / count(*) * 100, 2) AS reduction FROM documents WHERE text IS NOT NULL GROUP BY source")
def agg25_reduction(t: Tables) -> DataFrame:
    g = t.documents.where("text is not null").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("uniq"))
    return g.withColumn("reduction", dedupe.reduction(F.col("n"), F.col("uniq")))


@R.query(f"SELECT coalesce(avg(score), 0) AS mean FROM ({LEXICAL})")
def agg17_mean_relevance(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").select(F.round(retrieval.lexical(F.col("text"), "worthless trash nation"), 6).alias("score"))
    return d.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 9).alias("mean"))


R.sql["agg17_mean_relevance"] = f"SELECT round(coalesce(avg(score), 0), 9) AS mean FROM ({LEXICAL})"


@R.query("SELECT event_id, round(1 / (1 + greatest(value - 10, 0)), 9) AS rank_score, round(-greatest(-100, least(0, -value)) / 100, 9) AS score, round(1 + greatest(-100, least(0, -value)) / 100, 9) AS compat FROM events")
def mth4_rank_scores(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.round(V.rank_score(v - 10), 9).alias("rank_score"), F.round(V.bm25_score(-v), 9).alias("score"), F.round(V.bm25_score(-v, compat=True), 9).alias("compat"))


#: Hits of each language with their words and their order; for SQL that takes one after another.
HITS = f"""hits AS (SELECT h.id, d.lang, h.score, d.text, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+')) AS w, row_number() OVER (PARTITION BY d.lang ORDER BY h.score DESC, h.id) AS rk
    FROM ({BM25} ORDER BY score DESC, id LIMIT {{}}) h JOIN documents d ON d.doc_id = h.id)"""

R.sql["rnk7_mmr"] = f"""WITH RECURSIVE {HITS.format(30)},
rel AS (SELECT *, CASE WHEN max(score) OVER l > min(score) OVER l THEN (score - min(score) OVER l) / (max(score) OVER l - min(score) OVER l) ELSE 1.0::DOUBLE END AS r FROM hits WINDOW l AS (PARTITION BY lang)),
sims AS (SELECT a.id, map_from_entries(list((b.id, len(list_intersect(a.w, b.w))::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))))) AS m FROM hits a JOIN hits b ON a.lang = b.lang GROUP BY a.id),
run(lang, place, chosen) AS (
    SELECT DISTINCT lang, 0::BIGINT, []::BIGINT[] FROM hits
    UNION ALL
    SELECT lang, place + 1, list_append(any_value(chosen), arg_max(id, (v, score, -rk))) FROM (
        SELECT x.lang, place, chosen, id, score, rk, 0.7::DOUBLE * r - (1 - 0.7::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda c: m[c])), 0) AS v
        FROM run x JOIN rel ON rel.lang = x.lang AND NOT list_contains(chosen, rel.id) JOIN sims USING (id)) GROUP BY lang, place)
SELECT run.lang, chosen[place] AS id, score, place::INT AS place FROM run JOIN hits ON hits.id = chosen[place] WHERE place > 0"""

R.sql["ctx_dedupe_greedy"] = f"""WITH RECURSIVE {HITS.format(50)},
own AS (SELECT id, lang, score, text, list_filter(list_distinct(string_split_regex(lower(text), '\\s+')), lambda x: length(x) > 2) AS w, row_number() OVER (PARTITION BY lang ORDER BY id) AS n FROM hits),
alike AS (SELECT a.id, list(b.id) FILTER (a.text = b.text OR len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.85) AS like_it,
    map_from_entries(list((b.id, b.score))) AS scores FROM own a JOIN own b ON a.lang = b.lang GROUP BY a.id),
run(lang, n, firsts, bests) AS (
    SELECT DISTINCT lang, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM own
    UNION ALL
    SELECT lang, n, CASE WHEN spot IS NULL THEN list_append(firsts, id) ELSE firsts END,
        CASE WHEN spot IS NULL THEN list_append(bests, id) WHEN score >= scores[bests[spot]] THEN list_concat(list_append(bests[:spot - 1], id), bests[spot + 1:]) ELSE bests END
    FROM (SELECT o.lang, o.n, o.id, o.score, firsts, bests, scores, list_min(list_filter(range(1, len(bests) + 1), lambda j: list_contains(like_it, bests[j]))) AS spot
        FROM run x JOIN own o ON o.lang = x.lang AND o.n = x.n + 1 JOIN alike USING (id))),
final AS (SELECT lang, arg_max(firsts, n) AS firsts, arg_max(bests, n) AS bests FROM run GROUP BY lang)
SELECT lang, unnest(bests) AS id, unnest(firsts) AS first FROM final"""
