import random
import re

import pytest

from larkspur.llm import common, minhash
from larkspur.llm.components import components
from tests.llm.helpers import odd_docs, sample_docs


def shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def copies(n=60, seed=1):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(200)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(200)] = "w" + str(rng.randrange(1000))
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("made", [odd_docs, sample_docs, lambda s: odd_docs(s, copies()), lambda s: odd_docs(s, copies(90, 2))])
def test_components_against_all_pairs(spark, made):
    docs = made(spark).repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "A b\tc d E f"), (1, "A b\tc d E f")], "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200)], "a long, b long")
    got = dict(map(tuple, components(links).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}


def test_signature_estimates_similarity():
    import numpy as np

    c = minhash.Circulant()
    x = minhash.mixed(np.arange(1, 2001, dtype=np.uint64))
    y = np.concatenate([x[:1600], minhash.mixed(np.arange(9001, 9401, dtype=np.uint64))])
    assert abs((c.signature(x) == c.signature(y)).mean() - 1600 / 2400) < 0.12


def unlike_texts_with_a_shared_passage(n=40, seed=3):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    return [" ".join([f"u{k}x{i}" for i in range(rng.randrange(5, 90))] + passage + [f"v{k % 30}x{i}" for i in range(30)]) for k in range(n)]


@pytest.mark.parametrize("broadcast", [0, 2_000_000])
def test_order_by_frequency_joined_or_broadcast(spark, broadcast, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(minhash, "FREQUENT", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    docs = odd_docs(spark, copies(30, 4) + unlike_texts_with_a_shared_passage()).repartition(3)
    got = sorted(map(tuple, minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_hot_join_is_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    left = spark.createDataFrame([(k % 7 if k % 11 else None, k) for k in range(3000)] + [(1000 + k, k) for k in range(2000)], "key long, v long")
    right = spark.createDataFrame([(k, f"x{k}") for k in (0, 2, 5, 6, 1003, 5000)], "key long, x string")
    assert sorted(map(str, common.hot_join(left, right, "key").collect())) == sorted(map(str, left.join(right, "key", "left").collect()))


def test_pairs_just_above_the_threshold_are_linked(spark):
    """Pairs with a similarity of 0.75 to 0.77: n words, of which the last are others."""
    texts = []
    for k in range(300):
        words = [f"w{k}x{i}" for i in range(164)]
        texts += [" ".join(words), " ".join(words[:142] + [f"z{k}x{i}" for i in range(22)])]
    sim = len(shingles(texts[0]) & shingles(texts[1])) / len(shingles(texts[0]) | shingles(texts[1]))
    assert 0.75 <= sim < 0.77
    rows = minhash.near_duplicates(odd_docs(spark, texts)).collect()
    assert sum(not r.kept for r in rows) == 300
