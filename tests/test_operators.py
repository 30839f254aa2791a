"""Relational operators on hand-made rows."""

from pyspark.sql import functions as F

from larkspur.operators import dedupe, graph, history, retrieval, usage
from larkspur.plans import graph_queries
from larkspur.plans import catalog
from larkspur.plans.registry import Tables


def test_fusion(spark):
    v = spark.createDataFrame([("a", 0.9, "v")], "id string, vector_score double, snippet string")
    k = spark.createDataFrame([("b", 1.0, "k")], "id string, text_score double, snippet string")
    got = {r.id: round(r.score, 6) for r in retrieval.merge_hits(v, k).collect()}
    assert got == {"a": 0.63, "b": 0.3}
    both = retrieval.merge_hits(v.withColumn("vector_score", F.lit(0.2)), k.withColumn("id", F.lit("a")), 0.5, 0.5).head()
    assert (round(both.score, 6), both.snippet) == (0.6, "k")


def test_diverse_order():
    texts = ["red apple pie", "red apple pie", "blue sky"]
    assert retrieval.mmr_order([1.0, 0.99, 0.5], texts, 0.5) == [0, 2, 1]
    assert retrieval.mmr_order([0.1, 0.9, 0.5], texts, 1.0) == [1, 2, 0]
    assert retrieval.mmr_order([0.5, 0.5], ["", ""], 0.0) == [0, 1]
    assert retrieval.mmr_order([], [], 0.5) == []


def test_level_cuts(spark):
    hits = spark.createDataFrame([("q", i, 0.8 - 0.05 * i) for i in range(10)], "q string, id int, score double")
    n = lambda level, **k: retrieval.cut(hits, "q", level, **k).count()
    assert (n("general"), n("moderate"), n("focused")) == (10, 6, 3)
    assert n("general", most=4) == 4


def test_packing_stops_at_the_first_overflow(spark):
    hits = spark.createDataFrame([("q", 1, 0.9, "x" * 40), ("q", 2, 0.8, "x" * 400), ("q", 3, 0.7, "x" * 4)], "q string, id int, score double, content string")
    assert [r.id for r in retrieval.packed(hits, "q", 50).collect()] == [1]


def test_boost_and_lexical(spark):
    hits = spark.createDataFrame([(1, 0.5, "The quick brown fox")], "id int, score double, content string")
    assert round(retrieval.boosted(hits, "quick fox").head().score, 6) == 0.7
    score = lambda q: spark.range(1).select(retrieval.lexical(F.lit("The quick brown fox"), q)).head()[0]
    assert score("quick brown") == 0.95 and score("fox quick") == 0.9 and round(score("fox dog cow cat"), 6) == 0.175 and score("cow") == 0


def test_last_user_turns(spark):
    turns = lambda roles: spark.createDataFrame([(1, i, r) for i, r in enumerate(roles)], "conv_id int, turn int, role string")
    u, a = "user", "assistant"
    assert history.last_user_turns(turns([u, a, u, a, u, a]), 2).count() == 4
    assert history.last_user_turns(turns([u, a, a, u, a]), 1).count() == 2
    assert [history.last_user_turns(turns([u, a, u]), n).count() for n in (0, -1, None, 9)] == [3, 3, 3, 3]


def test_greedy_merge_keeps_the_first_place(spark):
    rows = [("q", 1, "alpha beta gamma delta", 0.1, 5), ("q", 2, "other words entirely here", 0.5, 5), ("q", 3, "alpha beta gamma delta", 0.9, 1), ("q", 4, "", 0.1, 1), ("q", 5, "a b", 0.1, 1)]
    m = spark.createDataFrame(rows, "q string, id int, content string, score double, ts long")
    assert [(r.id, r.first) for r in dedupe.greedy(m, "q").orderBy("first").collect()] == [(3, 1), (2, 2), (4, 4), (5, 5)]


def test_khop_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("c", "a", 1.0), ("b", "d", 0.1)], "src string, dst string, confidence double")
    got = sorted(map(tuple, graph.khop(e, spark.createDataFrame([("a",)], "node string"), 3, 0.2).collect()))
    assert got == [("a", "b", 1, 0.9), ("a", "c", 2, 0.45)]


def test_same_pairs_by_brute_force(spark):
    rows = [(None, "x", 1), (1, None, 1), (2, "x", None), *((i % 23, "xyz"[i % 3], i % 2) for i in range(90))]
    d = spark.createDataFrame(rows, "id int, k string, n int")
    full = [r for r in rows if None not in r]
    want = sorted((a, b) for a, *g in full for b, *h in full if g == h and a < b)
    for block in (1, 4, 100):
        assert sorted(map(tuple, graph.same_pairs(d, "id", ["k", "n"], block, 50).collect())) == want
    assert graph.same_pairs(d.where("id > 99"), "id", ["k"]).collect() == []


def test_pairs_of_one_large_group_are_several_tasks(spark, tmp_path):
    n = 6000
    kind = F.when(F.col("id") % 2 == 0, "Small").otherwise("SMALL")
    spark.range(0, n, 1, 1).select(F.col("id").alias("p_partkey"), kind.alias("p_type"), F.lit(7).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    pairs = catalog.queries()["jn13_same_name"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    assert sum(r.n for r in pairs) == n * (n - 1) // 2
    assert (sum(r.a for r in pairs), sum(r.b for r in pairs)) == (sum(a * (n - 1 - a) for a in range(n)), sum(b * b for b in range(n)))
    assert max(r.n for r in pairs) < 0.6 * n * (n - 1) / 2


def test_meetings_of_one_large_group_are_made_by_several_tasks(spark):
    n, sc = 3000, spark.sparkContext
    sc.setJobGroup("meetings", "")
    try:
        pairs = graph.same_pairs(spark.range(0, n, 1, 1).withColumn("k", F.lit("one")), "id", ["k"], 8).count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert pairs == n * (n - 1) // 2
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("meetings") for s in tracker.getJobInfo(j).stageIds}
    tasks = [store.taskList(s, 0, 10_000) for s in stages]
    sent = [x.apply(i).taskMetrics().get().shuffleWriteMetrics().recordsWritten() for x in tasks for i in range(x.size())]
    blocks = n // 8
    assert sum(sent) > blocks * (blocks + 1) // 2 > 4 * max(sent)


def test_hints(spark):
    e = spark.createDataFrame([("A", "B", "ENJOYS", 0.95), ("B", "C", "IS_A", 0.98), ("C", "D", "IS_A", 1.0)], "src string, dst string, type string, confidence double")
    (h,) = graph.hints(e).collect()
    assert (h.start, h.end, h.pattern, round(h.confidence, 3)) == ("A", "C", "enjoys_category", 0.931)


def test_names_resolve_in_order(spark):
    entities = spark.createDataFrame([("Ken", ["k"]), ("user", ["me", "my"]), ("ME", [])], "name string, aliases array<string>")
    names = spark.createDataFrame([("Ken",), ("me",), ("KEN",), ("nobody",)], "name string")
    assert {r.name: (r.entity, r.method) for r in graph.resolved(names, entities).collect()} == {"Ken": ("Ken", "exact"), "me": ("user", "alias"), "KEN": ("Ken", "case"), "nobody": (None, "none")}


def test_series(spark):
    p = spark.createDataFrame([(1000, 100, 0.1, 10, 0), (2000, 200, 0.2, 0, 20), (3000, 5, 0.0, 5, 15)], "ts long, tokens long, cost double, input long, output long")
    (r,) = usage.range_totals(p, F.lit(3000), F.lit(1000)).collect()
    assert (r.tokens, round(r.cost, 6), r.user_messages, r.assistant_messages, r.duration) == (305, 0.3, 2, 2, 2000)
    assert usage.range_totals(p, F.lit(5000), F.lit(6000)).collect() == []


def test_nearest_rank(spark):
    at = lambda n, p: spark.range(1).select(usage.nearest_rank(F.sequence(F.lit(1), F.lit(n)), p)).head()[0]
    assert (at(20, 0.95), at(100, 0.95), at(1, 0.99)) == (20, 96, 1)


def test_calls_and_results(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", ["a", "b"], []), (1, 1, "user", [], ["b"]), (1, 2, "assistant", ["c"], [])], "conv_id int, turn int, role string, calls array<string>, answers array<string>")
    assert [r.calls for r in history.answered_calls(turns).orderBy("turn").collect()] == [["b"], [], []]


def test_best_match_and_aliases(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = graph.best_match(names("kubernetis", "zzz"), names("kubernetes", "kuber")).collect()
    assert [(r.name, r.match, r.ratio) for r in got] == [("kubernetis", "kubernetes", 0.9)]
    e = spark.createDataFrame([("Bob", ["b"], 1), ("bob", ["bobby"], 3)], "name string, aliases array<string>, mentions int")
    (r,) = graph.combined_aliases(e).collect()
    assert (r.canonical, r.aliases, r.mentions) == ("bob", ["Bob", "b", "bobby"], 4)


def test_near_names_are_not_gathered_before_they_are_compared(spark):
    names = spark.createDataFrame([("abcdefghij",), ("abcdefghix",), ("zz",)], "name string")
    d = graph.best_match(names, names, 0.8, others=True)
    assert sorted(map(tuple, d.collect())) == [("abcdefghij", "abcdefghix", 0.9), ("abcdefghix", "abcdefghij", 0.9)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [name#" in plan and not any("Aggregate [name#" in x and "match#" in x.split("]")[0] or "piece#" in x.split("]")[0] and "Aggregate [" in x for x in plan.split("\n"))


def test_edges_are_dealt_out_before_they_are_told_apart(spark):
    plan = graph_queries.edges(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"RepartitionByExpression [{k}#" in plan for k in ("o_custkey", "l_orderkey", "s_suppkey"))
