"""Groups of entities against a search from every node, with chains, hubs and nulls."""

import random

import pytest

from larkspur.operators import graph, merge, skew


def reached(links):
    near = {}
    for a, b in links:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    root = {}
    for n in sorted(near):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = n
                todo += near[x]
    return root


@pytest.mark.parametrize("task_rows", [5, 1 << 20])
def test_components_of_chains_hubs_and_random_links(spark, task_rows):
    rng = random.Random(8)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)]
    links += [(7, 7), (8, 8), (8, 9), (None, 3), (4, None), (9, 8)]
    got = merge.components(spark.createDataFrame(links, "a long, b long"), task_rows).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == reached(links)


def test_no_links(spark):
    assert merge.components(spark.createDataFrame([], "a long, b long")).collect() == []


def entities(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, name string, aliases array<string>, mentions long")


ROWS = [(1, "Bob", ["bobby"], 3), (2, "BOB", None, 5), (3, "Robert", ["Bobby", "rob"], 1), (4, "Alice", [], 2), (5, None, ["ROB", None], 9), (6, None, None, 1), (None, "Bob", [], 1), (7, "Alicia", ["alice"], 2), (8, "Robertt", [], 4)]


def test_groups_over_several_links_by_names_and_aliases(spark):
    got = {r.entity_id: r.group_id for r in merge.groups(entities(spark, ROWS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4, 7: 4, 8: 8}
    alike = {r.entity_id: r.group_id for r in merge.groups(entities(spark, ROWS), 0.8).collect()}
    assert alike[8] == 1 and alike[4] == 4


def test_what_becomes_of_groups(spark):
    e = entities(spark, ROWS[:5])
    one, aliases = merge.merged(e, merge.groups(e))
    assert {tuple(r) for r in one.collect()} == {(1, "BOB", 4, 18), (4, "Alice", 1, 2)}
    assert {(r.group_id, r.alias.lower()) for r in aliases.collect()} == {(1, "bobby"), (1, "robert"), (1, "rob")}
    edges = spark.createDataFrame([(1, 4, "K", 0.5, 1), (3, 4, "K", 0.9, 2), (2, 3, "K", 1.0, 1), (4, 99, "K", 0.1, 1)], "src long, dst long, type string, confidence double, mentions long")
    got = {tuple(r) for r in merge.merged_relations(edges, merge.groups(e)).collect()}
    assert got == {(1, 4, "K", 0.9, 3, 2), (4, 99, "K", 0.1, 1, 1)}


def test_cascade_takes_the_first_answer(spark):
    names = spark.createDataFrame([(" ME ",), ("kubernets",), ("Docker",), ("docker",), ("nothing like it",), (None,)], "name string")
    known = spark.createDataFrame([("Kubernetes",), ("docker",), ("me",)], "name string")
    table = lambda *r: spark.createDataFrame(r, "name string, canonical string")
    got = {r.name: (r.canonical, r.method, round(r.confidence, 2)) for r in merge.canonicalised(names, known, table(("DOCKER", "Docker Inc")), table(("me", "user"), ("docker", "late"))).collect()}
    assert got == {" ME ": ("user", "alias", 0.95), "kubernets": ("Kubernetes", "fuzzy", 0.9), "Docker": ("Docker Inc", "cache", 1.0), "docker": ("Docker Inc", "cache", 1.0), "nothing like it": ("nothing like it", "self", 0.5)}


@pytest.mark.parametrize("block", [2, 256])
def test_pairs_of_a_hot_group_with_repeated_keys(spark, monkeypatch, block):
    monkeypatch.setattr(skew, "TASK_ROWS", 4)
    rows = [(i % 23, "hot") for i in range(40)] + [(1, "b"), (2, "b"), (3, "c"), (None, "b"), (4, None)]
    got = sorted(map(tuple, graph.same_pairs(spark.createDataFrame(rows, "k long, g string"), "k", ["g"], block=block).collect()))
    want = sorted((a, b) for i, (a, g) in enumerate(rows) for j, (b, h) in enumerate(rows) if i != j and g == h and g is not None and a is not None and b is not None and a < b)
    assert got == want
