"""Components against numpy on all rows at once."""

import math

import numpy as np
import pytest

from larkspur.llm import queries, whitening
from tests.llm.helpers import SF


def fine(v):
    return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)


def check(got, rows, most=8):
    """got: rows of whitened(); rows: (vec_id, vector) that take part."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array([[a - s / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    white = centred @ axes[:, order] / np.sqrt(values[order])
    want = sorted((str(i), k + 1, n, deviation[j], round(abs(white[j, k]), 6)) for j, (i, _) in enumerate(rows) for k in range(len(order)))
    assert sorted((str(r.vec_id), r.component, r.n, int(r.exact_deviation), round(abs(r.whitened), 6)) for r in got) == want
    for r in got:
        assert abs(r.explained / (values[order][r.component - 1] / values.sum()) - 1) < 1e-8
        assert r.identity_error < 1e-8
        assert r.deviation == (int(r.exact_deviation) if int(r.exact_deviation) < 1 << 63 else None)


@pytest.mark.parametrize("tasks", [1, 6])
def test_against_numpy(spark, tasks):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(tasks)
    check(whitening.whitened(vectors).collect(), [(r.vec_id, r.embedding) for r in vectors.collect() if fine(r.embedding)])
    assert queries.queries()["op13_chan_whitening"](spark, SF).columns == "vec_id component n deviation whitened explained identity_error".split()


def test_bad_vectors_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 50 if i % 9 else None, (rng.normal(size=5) * [1, 2, 3, 4, 5]).tolist()) for i in range(120)]
    bad = [(1, None), (2, []), (3, [1.0, None, 0.0, 0.0, 0.0]), (4, [float("nan")] * 5), (5, [float("inf")] * 5), (6, [1.0, 2.0]), (7, [1e30] * 5)]
    vectors = spark.createDataFrame([(*r, 1, "x", 2) for r in rows + bad], "vec_id long, embedding array<double>, n int, x string, component int")
    check(whitening.whitened(vectors.repartition(4)).collect(), rows)
    assert whitening.whitened(vectors.limit(0)).collect() == []
    assert whitening.whitened(vectors.where("vec_id = 6 and size(embedding) = 2")).count() == 2


def test_no_variance_gives_null(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 2), 5.0]) for i in range(30)], "vec_id long, embedding array<float>")
    got = whitening.whitened(vectors).collect()
    assert len(got) == 90
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in got if r.component == 1)


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(2**30 * (i % 3)), float(i)]) for i in range(2000)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=1).collect()
    n, xs = 2000, [[1024 * int(a) + 100_000 for a in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    want = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in enumerate(xs)}
    assert all(int(r.exact_deviation) == want[r.vec_id] and (r.deviation is None) == (want[r.vec_id] >= 1 << 63) for r in got)


def test_merging_is_exact_far_from_zero():
    rng = np.random.default_rng(0)
    x = rng.integers(-50, 50, size=(999, 4)) + (1 << 40)
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 200, 201, 700])]
    m = whitening.NONE
    for p in parts:
        m = m.merge(p)
    exact = np.cov(x - (1 << 40), rowvar=False, bias=True)
    assert m.n == 999 and m.sums == x.sum(axis=0).tolist()
    assert np.allclose(m.scatter / m.n, exact, rtol=1e-12)
