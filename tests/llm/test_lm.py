import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import gru, lm
from tests.llm.helpers import odd_docs, sample_docs


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def brute(rows):
    out = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(t for d, text in rows if not out(d) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return {d: (out(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for d, t in rows}


@pytest.mark.parametrize("frequent", [200_000, 40])
@pytest.mark.parametrize("made", [odd_docs, sample_docs])
def test_base_against_brute_force(spark, made, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = made(spark).repartition(2)
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    rows = lm.scored(docs).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_no_documents_and_no_training_documents(spark):
    assert lm.scored(odd_docs(spark).limit(0)).collect() == []
    alone = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 5 == 1)
    (r,) = lm.scored(spark.createDataFrame([(alone, "a b a")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (4, 0, 0)
    assert math.isclose(r.base_score, 0.0, abs_tol=1e-12)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    r = lm.scored(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").head()
    assert r.s > r.b + 0.05 * r.n  # a tenth of a decade a token at least


def test_gradients():
    rng = np.random.default_rng(0)
    flat = gru.initial(np.ones(lm.WORDS) / lm.WORDS).astype(np.float64)
    sizes = (5, 9, 3, 0, 7)
    lanes = gru.Lanes.of(rng.integers(0, lm.WORDS - 1, sum(sizes)).astype(np.int16), np.concatenate([[0], np.cumsum(sizes)]), lm.WORDS - 1, 2)
    x, y, first, _ = next(lanes.windows(40))
    valid, h = y >= 0, np.zeros((x.shape[1], gru.HIDDEN))

    def loss(f):
        w = gru.unflatten(f)
        states, _ = gru.forward(w, x, first, h, keep=False)
        return -gru.log_likelihood(w, states[valid].astype(np.float64), y[valid])[0].sum()

    g = np.zeros(gru.SIZE)
    w, grad = gru.unflatten(flat), gru.unflatten(g)
    states, tape = gru.forward(w, x, first, h, keep=True)
    d = np.zeros_like(states)
    _, d[valid] = gru.log_likelihood(w, states[valid], y[valid], grad)
    gru.backward(w, x, first, tape, d, grad)
    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-3), 20, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-3
        down[i] -= 1e-3
        assert abs((loss(up) - loss(down)) / 2e-3 - g[i]) < 1e-2 * abs(g[i]) + 1e-3


def test_states_go_on_across_windows_and_start_anew_with_documents():
    rng = np.random.default_rng(1)
    w = gru.unflatten(gru.initial(np.ones(lm.WORDS) / lm.WORDS))
    sizes = np.array([70, 3, 0, 200, 1, 33])
    codes, at = rng.integers(0, lm.WORDS - 1, sizes.sum()).astype(np.int16), np.concatenate([[0], np.cumsum(sizes)])
    together = gru.score(w, gru.Lanes.of(codes, at, 7, 2), len(sizes), steps=16)
    for k in range(len(sizes)):
        own = codes[at[k] : at[k + 1]]
        alone = gru.score(w, gru.Lanes.of(own, np.array([0, len(own)]), 7, 1), 1, steps=1000)[0]
        assert abs(alone - together[k]) < 1e-3 * max(1, abs(alone))


def test_probabilities_add_up_to_one():
    w = gru.unflatten(gru.initial(np.random.default_rng(2).random(lm.WORDS)))
    state = np.random.default_rng(3).normal(size=(1, gru.HIDDEN)).astype(np.float32)
    lp, _ = gru.log_likelihood(w, np.repeat(state, lm.WORDS, axis=0), np.arange(lm.WORDS))
    assert abs(np.exp(lp.astype(np.float64)).sum() - 1) < 1e-4
