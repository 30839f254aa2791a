"""The stored text index against scans of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import retrieval, textindex

WORDS = [f"w{i}" for i in range(40)]


def texts(n, seed):
    rng = random.Random(seed)
    return [(i, None if i % 50 == 7 else " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(40)], k=rng.randrange(0, 60)))) for i in range(n)]


def queries(spark, n=12, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.sample(WORDS, rng.randrange(1, 5)), i % 3 == 0) for i in range(n)]
    return spark.createDataFrame([*rows, (99, ["nowhere"], False), (98, ["w1", "nowhere"], True), (97, [], False)], "query_id long, terms array<string>, every boolean")


def scanned(spark, rows, asked, k):
    docs = spark.createDataFrame(rows, "id long, text string")
    out = set()
    for q in asked.collect():
        if not q.terms:
            continue
        hits = retrieval.bm25(docs, "id", "text", q.terms, 10_000).collect()
        has = {i: set((t or "").split()) for i, t in rows}
        good = [h for h in hits if not q.every or set(q.terms) <= has[h.id]][:k]
        out |= {(q.query_id, h.id, h.score) for h in good}
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(textindex, "SPAN_BITS", 3)
    monkeypatch.setattr(textindex, "PROMISING", 2)


def test_pruned_search_equals_a_scan(spark, tmp_path, small_blocks):
    rows, path = texts(300, 1), f"file://{tmp_path}/index"
    textindex.add(spark.createDataFrame(rows, "id long, text string").repartition(3), path)
    asked = queries(spark)
    got = textindex.search(spark, path, asked, 4)
    assert set(map(tuple, got.collect())) == scanned(spark, rows, asked, 4)


def test_replaced_deleted_merged_and_cleared(spark, tmp_path, small_blocks):
    rows, path, asked = dict(texts(200, 1)), f"file://{tmp_path}/index", queries(spark)
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    same = lambda: set(map(tuple, textindex.search(spark, path, asked, 5).collect())) == scanned(spark, list(rows.items()), asked, 5)
    assert textindex.search(spark, path, asked, 5).collect() == []
    textindex.add(frame(rows), path)
    newer = {i: t for i, t in [(k + 150, t) for k, t in texts(100, 2)]}
    textindex.add(frame(newer), path)
    rows |= newer
    assert same()
    gone = [3, 160, 240, 777]
    textindex.delete(spark.createDataFrame([(i,) for i in gone], "id long"), path)
    rows = {i: t for i, t in rows.items() if i not in gone}
    assert same() and len(textindex.segments(spark, path)) == 3
    textindex.optimise(spark, path)
    assert same() and len(textindex.segments(spark, path)) == 1
    assert textindex.vacuum(spark, path) == 3 and same()
    counted = {}
    for t in rows.values():
        for w in (t or "").split():
            counted[w] = counted.get(w, 0) + 1
    assert {r.term: r.occurrences for r in textindex.terms_of(spark, path).collect()} == counted
    textindex.clear(spark, path)
    assert textindex.search(spark, path, asked, 5).collect() == []


def test_a_segment_that_is_not_whole_is_not_read(spark, tmp_path):
    rows, path, asked = texts(60, 4), f"file://{tmp_path}/index", queries(spark)
    textindex.add(spark.createDataFrame(rows, "id long, text string"), path)
    (tmp_path / "index" / "segment=000002-dead" / "postings").mkdir(parents=True)
    assert set(map(tuple, textindex.search(spark, path, asked, 5).collect())) == scanned(spark, rows, asked, 5)


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    textindex.add(spark.createDataFrame(texts(100, 5), "id long, text string"), path)
    asked = spark.createDataFrame([(1, ["w1", "w2"], False)], "query_id long, terms array<string>, every boolean")
    plan = textindex.search(spark, path, asked, 3)._jdf.queryExecution().executedPlan().toString()
    buckets = {r[0] for r in spark.createDataFrame([("w1",), ("w2",)], "t string").select(textindex.bucket(F.col("t"))).collect()}
    assert "PartitionFilters: [bucket#" in plan and "In(term, [w1,w2])" in plan
    assert all(str(b) in plan.split("PartitionFilters: [bucket#")[1].split("]")[0] for b in buckets)


def test_expressions(spark):
    rows = [(1, '"a" AND "B"'), (2, '"a" OR "b" OR "a"'), (3, None), (4, "bare"), (5, '"one"')]
    got = {r.query_id: (r.terms, r.every) for r in textindex.parsed(spark.createDataFrame(rows, "query_id long, match string")).collect()}
    assert got == {1: (["a", "b"], True), 2: (["a", "b"], False), 3: ([], True), 4: ([], True), 5: (["one"], True)}


def test_text_ids_ties_and_repeated_ids(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([("b", "same words"), ("a", "same words"), ("c", "x"), ("c", "same"), (None, "same")], "id string, text string")
    textindex.add(docs, path)
    asked = spark.createDataFrame([("q", ["same"], False)], "query_id string, terms array<string>, every boolean")
    assert {r.id for r in textindex.search(spark, path, asked, 2, "string").collect()} == {"a", "b"}  # "x" stayed for c


def test_long_texts_end_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BLOCK_WORDS", 100)
    rows, path, asked = texts(120, 6), f"file://{tmp_path}/index", queries(spark)
    textindex.add(spark.createDataFrame(rows, "id long, text string"), path)
    blocks = textindex._blocks(spark, textindex.segments(spark, path))
    found = textindex.opened(blocks, "range").groupBy("range").agg(F.sum("tf").alias("words"), F.countDistinct("number").alias("n"))
    assert found.where("words > 100 and n > 1").count() == 0 and found.count() > 20
    got = textindex.search(spark, path, asked, 4)
    assert set(map(tuple, got.collect())) == scanned(spark, rows, asked, 4)


def test_optimised_again_and_only_dead_blocks(spark, tmp_path, small_blocks):
    rows, path, asked = texts(60, 7), f"file://{tmp_path}/index", queries(spark)
    frame = spark.createDataFrame(rows, "id long, text string")
    for d in (frame.where("id < 20"), frame):
        textindex.add(d, path)
    for _ in range(2):  # the second has nothing to merge
        textindex.optimise(spark, path)
        assert set(map(tuple, textindex.search(spark, path, asked, 4).collect())) == scanned(spark, rows, asked, 4)
