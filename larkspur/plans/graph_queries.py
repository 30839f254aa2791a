"""A graph from the star schema: customers buy parts that suppliers deliver, suppliers and customers live in nations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import graph, merge
from larkspur.operators.skew import with_facts
from larkspur.plans.registry import Registry, Tables

R = Registry()

EDGES = """SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type, 0.9::DOUBLE AS confidence FROM orders
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 's' || l_suppkey, 'USES', 0.8 FROM lineitem UNION ALL SELECT DISTINCT 's' || s_suppkey, 'n' || s_nationkey, 'IS_A', 0.5 FROM supplier"""


#: Rows of edges that a task tells apart at once.
TASK_EDGES = 1 << 19


def edges(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c)

    def e(d: DataFrame, p: str, a: str, q: str, b: str, kind: str, c: float) -> DataFrame:
        """Keys are dealt out before they are told apart: hardly any come twice in a task that reads them, so it would gather all it reads."""
        keys = d.select(a, b).repartition(1 + d.count() // TASK_EDGES, a, b).distinct()
        return keys.select(name(p, F.col(a)).alias("src"), name(q, F.col(b)).alias("dst"), F.lit(kind).alias("type"), F.lit(c).alias("confidence"))

    bought = e(t.orders, "c", "o_custkey", "o", "o_orderkey", "PLACED", 0.9)
    used = e(t.lineitem, "o", "l_orderkey", "s", "l_suppkey", "USES", 0.8)
    lives = e(t.supplier, "s", "s_suppkey", "n", "s_nationkey", "IS_A", 0.5)
    return bought.unionByName(used).unionByName(lives)


@R.query(f"""WITH RECURSIVE e AS ({EDGES}), w AS (SELECT DISTINCT src AS seed, src AS node, 0 AS hops, 1.0::DOUBLE AS c FROM e WHERE src LIKE 'c%' AND length(src) = 2
UNION ALL SELECT seed, dst, hops + 1, c * confidence FROM w JOIN e ON node = src WHERE hops < 3)
SELECT seed, node, hops, round(confidence, 6) AS confidence FROM (SELECT seed, node, hops, max(c) AS confidence, row_number() OVER (PARTITION BY seed, node ORDER BY hops) AS r FROM w WHERE hops > 0 GROUP BY seed, node, hops) WHERE r = 1""")
def grf2_khop(t: Tables) -> DataFrame:
    e = edges(t)
    seeds = e.where("src LIKE 'c_'").select(F.col("src").alias("node")).distinct()
    return graph.khop(e, seeds, 3).withColumn("confidence", F.round("confidence", 6))


@R.query("WITH p AS (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) SELECT e.event_id AS memory_id, e.user_id * 7 AS episode_id, 'memory' AS missing FROM events e ANTI JOIN p ON e.event_id = p.doc_id UNION ALL SELECT event_id, user_id * 7, 'episode' FROM events ANTI JOIN (SELECT conv_id FROM conversations) c ON user_id * 7 = conv_id")
def jn10_orphans(t: Tables) -> DataFrame:
    links = t.events.select(F.col("event_id").alias("memory_id"), (F.col("user_id") * 7).alias("episode_id"))
    return graph.orphans(links, t.documents.select(F.col("doc_id").alias("memory_id")), t.conversations.select(F.col("conv_id").alias("episode_id")).distinct())


@R.query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON lower(a.p_type) = lower(b.p_type) AND a.p_partkey < b.p_partkey WHERE a.p_size = b.p_size")
def jn13_same_name(t: Tables) -> DataFrame:
    return graph.same_pairs(t.part.select("p_partkey", F.lower("p_type").alias("k"), "p_size"), "p_partkey", ["k", "p_size"])


OLD = "SELECT 'u' || user_id AS src, event_type AS dst, 'USES' AS type, max(value) / 100 AS confidence, CASE WHEN user_id % 2 = 0 THEN 'old' END AS fact, count(*) AS mentions FROM events WHERE event_id % 2 = {} GROUP BY user_id, event_type"


def half(t: Tables, k: int) -> DataFrame:
    g = t.events.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg((F.max("value") / 100).alias("confidence"), F.count("*").alias("mentions"))
    fact = F.when(F.col("user_id") % 2 == 0, "old") if k == 0 else F.lit("new")
    return g.select(F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"), F.lit("USES").alias("type"), "confidence", fact.alias("fact"), "mentions")


@R.query(f"WITH o AS ({OLD.format(0)}), n AS ({OLD.format(1).replace(chr(39) + 'old' + chr(39) + ' END', chr(39) + 'new' + chr(39) + ' ELSE ' + chr(39) + 'new' + chr(39) + ' END')}), b AS (SELECT *, 0 AS age FROM o UNION ALL SELECT *, 1 FROM n) SELECT src, dst, type, round(max(confidence), 6) AS confidence, arg_min(fact, age) FILTER (fact IS NOT NULL) AS fact, sum(mentions)::BIGINT AS mentions FROM b GROUP BY src, dst, type")
def snk5_merge_edges(t: Tables) -> DataFrame:
    return graph.merged_edges(half(t, 0), half(t, 1)).withColumn("confidence", F.round("confidence", 6))


@R.query(f"""WITH e AS ({EDGES}), h AS (SELECT a.src AS start, b.dst AS "end", CASE WHEN a.type = 'PLACED' THEN NULL WHEN a.type = 'USES' AND b.type = 'IS_A' THEN 'x' END AS p, a.confidence * b.confidence AS c, a.type AS t1, b.type AS t2 FROM e a JOIN e b ON a.dst = b.src)
SELECT start, "end", 'works_with_technology' AS pattern, round(max(c), 6) AS confidence FROM h WHERE t1 = 'PLACED' AND t2 = 'USES' GROUP BY ALL""")
def grf4_hints(t: Tables) -> DataFrame:
    e = edges(t).withColumn("type", F.when(F.col("type") == "PLACED", "WORKS_ON").otherwise(F.col("type")))
    return graph.hints(e, 1 + (t.orders.count() + t.lineitem.count()) // TASK_EDGES).withColumn("confidence", F.round("confidence", 6))


@R.query("""WITH o(type, d, r) AS (VALUES ('USES', 'user', 'click'), ('SEES', 'user', 'view')), e AS (SELECT event_id, CASE WHEN event_type = 'click' THEN 'USES' WHEN event_type = 'view' THEN 'SEES' ELSE 'HAS' END AS type, value / 50 AS c, CASE WHEN user_id % 9 = 0 THEN 'bot' ELSE 'user' END AS f, CASE WHEN user_id % 5 = 0 THEN 'click' ELSE event_type END AS g FROM events)
SELECT event_id, concat_ws(',', CASE WHEN d IS NULL THEN 'unknown type' END, CASE WHEN NOT (c BETWEEN 0 AND 1) THEN 'confidence' END, CASE WHEN d <> f THEN 'domain' END, CASE WHEN r <> g THEN 'range' END) AS errors FROM e LEFT JOIN o USING (type)""")
def grf5_validate(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "USES").when(F.col("event_type") == "view", "SEES").otherwise("HAS")
    e = t.events.select("event_id", kind.alias("type"), (F.col("value") / 50).alias("confidence"), F.when(F.col("user_id") % 9 == 0, "bot").otherwise("user").alias("from_type"), F.when(F.col("user_id") % 5 == 0, "click").otherwise(F.col("event_type")).alias("to_type"))
    ontology = t.spark.createDataFrame([("USES", ["user"], ["click"]), ("SEES", ["user"], ["view"])], "type string, domain array<string>, range array<string>")
    return graph.validated(e, ontology).select("event_id", F.array_join("errors", ",").alias("errors"))


@R.query(f"WITH e AS ({EDGES}), i(type, inverse) AS (VALUES ('USES', 'USED_BY'), ('PLACED', 'PLACED')), a AS (SELECT src, dst, type, confidence FROM e UNION ALL SELECT dst, src, inverse, confidence FROM e JOIN i USING (type)) SELECT src, dst, type, max(confidence) AS confidence FROM a GROUP BY ALL")
def grf6_inverses(t: Tables) -> DataFrame:
    inverse = t.spark.createDataFrame([("USES", "USED_BY"), ("PLACED", "PLACED")], "type string, inverse string")
    return graph.with_inverses(edges(t), inverse)


@R.query(f"WITH e AS ({EDGES}), m AS (SELECT *, CASE WHEN dst LIKE 's%' THEN 'S' || right(dst, 1) ELSE dst END AS d, CASE WHEN src LIKE 's%' THEN 'S' || right(src, 1) ELSE src END AS s FROM e) SELECT s AS src, d AS dst, type, max(confidence) AS confidence FROM m WHERE s <> d GROUP BY s, d, type")
def jn14_repointed(t: Tables) -> DataFrame:
    canonical = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("alias"), F.concat(F.lit("S"), F.right(F.col("s_suppkey").cast("string"), F.lit(1))).alias("name"))
    return graph.repointed(edges(t), canonical)


ENTITIES = "SELECT p_partkey AS entity_id, p_name AS name, 'x' || p_size AS alias, p_size AS mentions FROM part"


def entities(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array(F.concat(F.lit("x"), "p_size")).alias("aliases"), F.col("p_size").alias("mentions"))


@R.query(f"""WITH e AS ({ENTITIES}), k AS (SELECT lower(name) AS key, arg_max(name, (mentions, name)) AS canonical, sum(mentions)::BIGINT AS mentions FROM e GROUP BY 1), a AS (SELECT lower(name) AS key, alias AS x FROM e UNION SELECT lower(name), name FROM e)
SELECT key, canonical, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM a WHERE a.key = k.key AND x <> canonical), '') AS aliases, mentions FROM k""")
def agg24_combined_aliases(t: Tables) -> DataFrame:
    return graph.combined_aliases(entities(t)).withColumn("aliases", F.array_join("aliases", ","))


@R.query(f"""WITH e AS ({ENTITIES}), n AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN 'x' || p_size ELSE 'nothing' || p_partkey END AS name FROM part),
x AS (SELECT DISTINCT name FROM e), a AS (SELECT alias, min(name) AS m FROM e GROUP BY 1), l AS (SELECT lower(name) AS k, min(name) AS m FROM e GROUP BY 1)
SELECT n.name, coalesce(x.name, a.m, l.m) AS entity, CASE WHEN x.name IS NOT NULL THEN 'exact' WHEN a.m IS NOT NULL THEN 'alias' WHEN l.m IS NOT NULL THEN 'case' ELSE 'none' END AS method FROM n LEFT JOIN x ON x.name = n.name LEFT JOIN a ON a.alias = n.name LEFT JOIN l ON l.k = lower(n.name)""")
def jn17_resolve(t: Tables) -> DataFrame:
    k, p = F.col("p_partkey") % 4, F.col("p_name")
    names = t.part.select(F.when(k == 0, p).when(k == 1, F.upper(p)).when(k == 2, F.concat(F.lit("x"), "p_size")).otherwise(F.concat(F.lit("nothing"), "p_partkey")).alias("name")).distinct()
    return graph.resolved(names, entities(t))


@R.query("""WITH n AS (SELECT DISTINCT left(p_name, -1) || p_size % 10 AS name FROM part), m AS (SELECT DISTINCT p_name AS match FROM part),
p AS (SELECT name, match, 1 - levenshtein(name, match) / greatest(length(name), length(match)) AS ratio FROM n, m)
SELECT name, match, round(ratio, 6) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, match) AS r FROM p WHERE ratio >= 0.8) WHERE r = 1""")
def jn7_best_match(t: Tables) -> DataFrame:
    names = t.part.select(F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.col("p_size") % 10).alias("name"))
    return graph.best_match(names, t.part.select(F.col("p_name").alias("name"))).withColumn("ratio", F.round("ratio", 6))


@R.query("""WITH m AS (SELECT l_orderkey AS episode_id, l_partkey AS entity_id, max(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2), h AS (SELECT DISTINCT p_partkey AS entity_id FROM part WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_partkey <= 20) OR 'x' || p_size = 'x7')
SELECT episode_id, count(DISTINCT entity_id) AS shared, max(ts) AS ts FROM m JOIN h USING (entity_id) GROUP BY 1 ORDER BY shared DESC, ts DESC, episode_id LIMIT 25""")
def grf1_episodes(t: Tables) -> DataFrame:
    mentions = t.lineitem.groupBy(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("entity_id")).agg(F.max("l_shipdate").alias("ts"))
    terms = [r[0] for r in t.part.where("p_partkey <= 20").select("p_name").collect()] + ["X7"]
    return graph.episodes_of(mentions, entities(t), terms, 25).drop("names")


@R.query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def jn15_semi(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.query("SELECT event_type, count(*) AS mentions FROM events GROUP BY 1 ORDER BY mentions DESC, 1 LIMIT 50")
def rnk11_top_entities(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "event_type").limit(50)


@R.query("SELECT DISTINCT lower(lang) AS x FROM documents UNION SELECT DISTINCT role FROM conversations")
def set2_union_distinct(t: Tables) -> DataFrame:
    return t.documents.select(F.lower("lang").alias("x")).union(t.conversations.select("role")).distinct()


@R.query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set5_except(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@R.query("SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT event_type), ['click', 'extra']))), ',') AS allowed FROM events GROUP BY 1")
def set7_allow_list(t: Tables) -> DataFrame:
    merged = F.array_union(F.collect_set("event_type"), F.array(F.lit("click"), F.lit("extra")))
    return t.events.groupBy("user_id").agg(F.array_join(F.sort_array(merged), ",").alias("allowed"))


def people(t: Tables) -> DataFrame:
    """Customers as entities: those of a nation with about the same balance share an alias, those of a segment another."""
    bal = lambda n: F.floor(F.col("c_acctbal") / n).cast("string")
    aliases = F.array(F.concat(F.lit("N"), "c_nationkey", F.lit("/"), bal(100)), F.concat(F.lower("c_mktsegment"), F.lit("/"), bal(10)))
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("mentions"))
    d = t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return d.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), aliases.alias("aliases"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


PEOPLE = """entity AS (SELECT c_custkey AS entity_id, c_name AS name, ['N' || c_nationkey || '/' || floor(c_acctbal / 100)::BIGINT, lower(c_mktsegment) || '/' || floor(c_acctbal / 10)::BIGINT] AS aliases,
    (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS mentions FROM customer),
term AS (SELECT DISTINCT entity_id, lower(unnest(list_append(aliases, name))) AS term FROM entity),
link AS (SELECT DISTINCT a.entity_id AS a, b.entity_id AS b FROM term a JOIN term b USING (term)),
reach(entity_id, root) AS (SELECT entity_id, entity_id FROM entity UNION SELECT link.b, root FROM reach JOIN link ON reach.entity_id = link.a WHERE root < link.b),
grp AS (SELECT entity_id, min(root) AS group_id FROM reach GROUP BY 1),
canon AS (SELECT group_id, arg_max(name, (mentions, name)) AS canonical, count(*) AS members, sum(mentions)::BIGINT AS mentions FROM entity JOIN grp USING (entity_id) GROUP BY 1)"""


@R.query(f"WITH RECURSIVE {PEOPLE} SELECT entity_id, group_id FROM grp")
def grf7_groups(t: Tables) -> DataFrame:
    return merge.groups(people(t))


@R.query(f"WITH RECURSIVE {PEOPLE} SELECT group_id, canonical, members, mentions FROM canon")
def grf7_merged(t: Tables) -> DataFrame:
    e = people(t)
    return merge.merged(e, merge.groups(e))[0]


@R.query(f"""WITH RECURSIVE {PEOPLE}, said AS (SELECT DISTINCT group_id, unnest(list_append(aliases, name)) AS alias FROM entity JOIN grp USING (entity_id))
SELECT group_id, alias FROM said JOIN canon USING (group_id) WHERE lower(alias) <> lower(canonical)""")
def grf7_aliases(t: Tables) -> DataFrame:
    e = people(t)
    return merge.merged(e, merge.groups(e))[1]


@R.query(f"""WITH RECURSIVE {PEOPLE}, edge AS (SELECT coalesce(x.group_id, o_custkey) AS src, coalesce(y.group_id, o_orderkey // 10) AS dst, o_orderstatus AS type, o_totalprice AS confidence FROM orders LEFT JOIN grp x ON x.entity_id = o_custkey LEFT JOIN grp y ON y.entity_id = o_orderkey // 10)
SELECT src, dst, type, max(confidence) AS confidence, count(*) * 2 AS mentions, count(*) AS merged FROM edge WHERE src <> dst GROUP BY ALL""")
def grf7_edges(t: Tables) -> DataFrame:
    edges = t.orders.select(F.col("o_custkey").alias("src"), F.expr("o_orderkey div 10").alias("dst"), F.col("o_orderstatus").alias("type"), F.col("o_totalprice").alias("confidence"), F.lit(2).alias("mentions"))
    return merge.merged_relations(edges, merge.groups(people(t)))


@R.query("""WITH RECURSIVE entity AS (SELECT min(p_partkey) AS entity_id, p_name || ' ' || p_brand AS name FROM part GROUP BY 2),
near AS (SELECT a.entity_id AS a, b.entity_id AS b, row_number() OVER (PARTITION BY a.entity_id ORDER BY 1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name)) DESC, lower(b.name)) AS r
    FROM entity a JOIN entity b ON a.entity_id <> b.entity_id AND 1 - levenshtein(lower(a.name), lower(b.name)) / greatest(length(a.name), length(b.name)) >= 0.9),
link AS (SELECT a, b FROM near WHERE r = 1 UNION SELECT b, a FROM near WHERE r = 1),
reach(entity_id, root) AS (SELECT entity_id, entity_id FROM entity UNION SELECT link.b, root FROM reach JOIN link ON reach.entity_id = link.a WHERE root < link.b)
SELECT entity_id, min(root) AS group_id FROM reach GROUP BY 1""")
def grf7_alike(t: Tables) -> DataFrame:
    """Names with brands that are nearly the same, over any number of steps."""
    e = t.part.groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("name")).agg(F.min("p_partkey").alias("entity_id")).withColumn("aliases", F.array().cast("array<string>"))
    return merge.groups(e, 0.9)


@R.query("SELECT p_partkey, min(p_partkey) OVER w AS class, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY lower(p_type), p_size)")
def jn13_classes(t: Tables) -> DataFrame:
    """What jn13_same_name lists as pairs, as a class for each part: as many rows as parts."""
    d = t.part.select("p_partkey", F.lower("p_type").alias("k"), "p_size")
    facts = d.groupBy("k", "p_size").agg(F.min("p_partkey").alias("class"), F.count("*").alias("n"))
    return with_facts(d, facts, ["k", "p_size"], counts=facts.select("k", "p_size", F.col("n").alias("count"))).select("p_partkey", "class", "n")


@R.query("""WITH n AS (SELECT DISTINCT name FROM (SELECT ' ' || upper(p_name) AS name FROM part UNION ALL SELECT p_name || 's' FROM part UNION ALL SELECT p_brand || ' ' || p_name FROM part UNION ALL SELECT s_name FROM supplier UNION ALL SELECT n_name FROM nation)),
cache AS (SELECT lower(p_name) AS key, 'cached ' || p_name AS canonical FROM part WHERE p_name LIKE '%t' GROUP BY ALL), alias AS (SELECT lower(n_name) AS key, 'nation ' || n_regionkey AS canonical FROM nation),
known AS (SELECT DISTINCT p_name AS match FROM part), todo AS (SELECT name, lower(trim(name)) AS key FROM n),
p AS (SELECT name, match, 1 - levenshtein(key, lower(match)) / greatest(length(key), length(match)) AS ratio FROM todo, known),
b AS (SELECT name, match, ratio FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ratio DESC, match) AS r FROM p WHERE ratio >= 0.8) WHERE r = 1)
SELECT name, coalesce(c.canonical, a.canonical, match, name) AS canonical, CASE WHEN c.canonical IS NOT NULL THEN 'cache' WHEN a.canonical IS NOT NULL THEN 'alias' WHEN match IS NOT NULL THEN 'fuzzy' ELSE 'self' END AS method,
round(CASE WHEN c.canonical IS NOT NULL THEN 1 WHEN a.canonical IS NOT NULL THEN 0.95 WHEN match IS NOT NULL THEN ratio ELSE 0.5 END, 6) AS confidence FROM todo LEFT JOIN cache c USING (key) LEFT JOIN alias a USING (key) LEFT JOIN b USING (name)""")
def txt18_cascade(t: Tables) -> DataFrame:
    """Names in all that may have them: in other cases, with an ending, with a brand before them; suppliers and nations too."""
    p = F.col("p_name")
    names = t.part.select(F.concat(F.lit(" "), F.upper(p)).alias("name")).union(t.part.select(F.concat(p, F.lit("s")))).union(t.part.select(F.concat_ws(" ", "p_brand", p))).union(t.supplier.select("s_name")).union(t.nation.select("n_name"))
    cache = t.part.where(p.endswith("t")).select(p.alias("name"), F.concat(F.lit("cached "), p).alias("canonical"))
    aliases = t.nation.select(F.col("n_name").alias("name"), F.concat(F.lit("nation "), "n_regionkey").alias("canonical"))
    d = merge.canonicalised(names, t.part.select(p.alias("name")), cache, aliases)
    return d.withColumn("confidence", F.round("confidence", 6))


VERTICES = """SELECT {0}(s_name) AS name, {1} AS type, ['S' || s_nationkey, CASE WHEN s_acctbal > 0 THEN 'rich' END, s_name] AS aliases, s_acctbal / 10000 AS confidence, s_nationkey + 1 AS mentions, s_suppkey {2} AS seen FROM supplier"""


@R.query(f"""WITH o AS ({VERTICES.format("lower", "CASE WHEN s_nationkey < 10 THEN 'Person' END", "")}), n AS ({VERTICES.format("upper", "'Org'", "+ 5").replace("'rich'", "'Rich'").replace("s_acctbal / 10000", "(s_nationkey / 30)")}),
b AS (SELECT *, 0 AS age, lower(name) AS key FROM o UNION ALL SELECT *, 1, lower(name) FROM n), a AS (SELECT DISTINCT key, lower(unnest(aliases)) AS x FROM b)
SELECT arg_min(name, age) AS name, arg_min(type, age) FILTER (type IS NOT NULL) AS type, (SELECT string_agg(x, ',' ORDER BY x) FROM a WHERE a.key = b.key AND x <> b.key) AS aliases, round(max(confidence), 6) AS confidence, sum(mentions)::BIGINT AS mentions, max(seen) AS seen FROM b GROUP BY key""")
def snk5_merge_vertices(t: Tables) -> DataFrame:
    def made(name, kind, rich, confidence, later):
        aliases = F.array(F.concat(F.lit("S"), "s_nationkey"), F.when(F.col("s_acctbal") > 0, rich), F.col("s_name"))
        return t.supplier.select(name.alias("name"), kind.alias("type"), aliases.alias("aliases"), confidence.alias("confidence"), (F.col("s_nationkey") + 1).alias("mentions"), (F.col("s_suppkey") + later).alias("seen"))

    old = made(F.lower("s_name"), F.when(F.col("s_nationkey") < 10, "Person"), "rich", F.col("s_acctbal") / 10000, 0)
    new = made(F.upper("s_name"), F.lit("Org"), "Rich", F.col("s_nationkey") / 30, 5)
    return graph.merged_vertices(old, new).withColumns({"aliases": F.array_join("aliases", ","), "confidence": F.round("confidence", 6)})


@R.query("""WITH m AS (SELECT l_orderkey AS episode_id, l_partkey AS entity_id, max(l_shipdate) AS ts FROM lineitem GROUP BY 1, 2), q AS (SELECT lower(n_name) AS x FROM nation UNION SELECT DISTINCT lower(p_name) FROM part WHERE p_size = 7 UNION SELECT 'x7'),
h AS (SELECT entity_id, min(x) AS term FROM (SELECT p_partkey AS entity_id, unnest([lower(p_name), 'x' || p_size]) AS x FROM part) JOIN q USING (x) GROUP BY 1)
SELECT episode_id, count(DISTINCT entity_id) AS shared, max(ts) AS ts, string_agg(DISTINCT term, ',' ORDER BY term) AS names FROM m JOIN h USING (entity_id) GROUP BY 1 ORDER BY shared DESC, ts DESC, episode_id LIMIT 40""")
def grf1_named_episodes(t: Tables) -> DataFrame:
    """Episodes with the names they share with the question."""
    mentions = t.lineitem.groupBy(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("entity_id")).agg(F.max("l_shipdate").alias("ts"))
    terms = [r[0] for r in t.nation.select("n_name").union(t.part.where("p_size = 7").select("p_name").distinct()).collect()] + ["X7"]  # a question's names
    return graph.episodes_of(mentions, entities(t), terms, 40).withColumn("names", F.array_join("names", ","))
