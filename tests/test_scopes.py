"""Queries over whole tables: rows beyond the test tables' own ids, forms and lengths, by brute force."""

import random

from larkspur.functions import memory
from larkspur.plans import catalog


def test_contained_takes_every_passage(spark, tmp_path):
    spark.createDataFrame([(1, "so it said the lazy dog sleeps all day long here"), (2, "nothing of the kind is in this text at all")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1000, "The lazy dog  sleeps all day long")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in catalog.queries()["jn16_contained"](spark, str(tmp_path)).collect()] == [1]


def test_already_sent_against_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["aa", "ab", "ba", "bb", "a"]) for _ in range(n))
    a = [text(rng.randint(1, 14)) for _ in range(150)]
    b = [text(rng.randint(1, 14)) for _ in range(40)]
    b += [x[rng.randint(0, 4):][: rng.randint(8, 30)] for x in a[:60]]  # cuts inside words
    rows = [(i % 140, x) for i, x in enumerate(a)]  # some ids twice
    got = memory.already_sent(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(x,) for x in b], "text string"))
    n, s = [(i, x.strip()) for i, x in rows], {x.strip() for x in b if len(x.strip()) >= 10}
    want = sorted(i for i, x in n if len(x) >= 10 and any(x in y or y in x for y in s))
    assert sorted(r.id for r in got.collect()) == want
    assert 20 < len(want) < 145


def test_sent_ways_by_marks_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(memory, "SENT_CHARS", 300)  # so that most short texts are found by marks
    collected, collect = [], type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda d: (rows := collect(d), collected.extend(x for r in rows for x in r if isinstance(x, str)))[0])
    syllables = ["the", "an ", "é", "ion", "re ", "ç", "st", "\U00020000"]
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(n)).split())
    a = [text(rng.randint(3, 40)) for _ in range(200)]
    b = [text(rng.randint(20, 60)) for _ in range(80)]
    b += [x[rng.randint(0, 6):][: rng.randint(10, 60)] for x in a[:100]]
    a += [x[rng.randint(0, 6):][: rng.randint(10, 60)] for x in b[:80]] * 2
    got = memory.sent_ways(spark.createDataFrame([(i // 2, x) for i, x in enumerate(a)], "id long, text string"), spark.createDataFrame([(x,) for x in b], "text string")).collect()
    s = {x.strip() for x in b if len(x.strip()) >= 10}
    ways = [(i // 2, any(y in x for y in s), any(x in y for y in s)) for i, x in enumerate(z.strip() for z in a) if len(x) >= 10]
    assert sorted(map(tuple, got)) == sorted(w for w in ways if w[1] or w[2])
    assert sum(map(len, collected)) <= 2 * 300


def test_resolve_takes_every_part(spark, tmp_path):
    spark.createDataFrame([(104, "red bolt", 5), (204, "red bolt", 6), (105, "Blue nut", 7), (106, "green pin", 6), (107, "tin", 8)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalog.queries()["jn17_resolve"](spark, str(tmp_path)).collect()))
    assert got == [("BLUE NUT", "Blue nut", "case"), ("nothing107", None, "none"), ("red bolt", "red bolt", "exact"), ("x6", "green pin", "alias")]


def test_markdown_takes_every_conversation(spark, tmp_path):
    rows = [(1, 0, "see [here](http://x.y) and `code`"), (1, 1, "1. one\r\n2. two"), (1, 2, "a\n\n\n\nb  c"), (1, 3, None), (1, 4, "# plain")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.plain for r in catalog.queries()["htm2_markdown_to_text"](spark, str(tmp_path)).collect()}
    assert got == {0: "see here and code", 1: "one\ntwo", 2: "a\n\nb c", 3: None, 4: "plain"}


def test_no_join_without_keys_for_contained_texts(spark):
    sent = spark.createDataFrame([("a short text here",), ("another one that is longer than six words are",)], "text string")
    plan = memory.already_sent(spark.createDataFrame([(1, "x")], "id long, text string"), sent)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
