import subprocess
import sys

import numpy as np
import pytest

from larkspur.llm import ann

SF = "/root/testdata/sf0.01"


def exact(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = [float(x) for x in v]
    out = {}
    for q in good:
        if q % 20 == 0:
            score = [(-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def test_recall_and_order(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in sorted(ann.search(vectors).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = exact([tuple(r) for r in vectors.select("vec_id", "embedding").collect()])
    assert got.keys() == want.keys()
    hit = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hit) >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        scores = dict(want[q])
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(scores[i] - s) < 1e-12 for i, s in found if i in scores)


@pytest.mark.parametrize("block", [4096, 16])
def test_ties_and_bad_vectors(spark, block):
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(60)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 0.0]), (120, [float("nan"), 1.0, 1.0]), (140, [1.0, 2.0]), (160, [3.0, -1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, part string")
    got = {}
    for r in sorted(ann.search(vectors, block=block).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == exact([r for r in rows if r[0] != 140])
    assert ann.search(vectors.limit(0)).collect() == []
    assert ann.search(vectors.where("vec_id = 0")).collect() == []


def test_rows_that_share_an_id_are_one_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(90)]
    other = [(i, [x + 1 for x in v]) for i, v in rows[:40]]
    vectors = spark.createDataFrame([r for r in rows + rows[:50] + other for _ in range(2)], "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(ann.search(vectors, parts=1).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    least = {}
    for i, v in vectors.collect():
        least[i] = min(least.get(i, tuple(v)), tuple(v))
    assert got == {q: [i for i, _ in f] for q, f in exact(list(least.items())).items()}


def test_recall_outside_the_sample(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([tuple(r) for r in vectors.select("vec_id", "embedding").collect()])
    seen = {r.vec_id for r in ann.sampled(ann.usable(vectors), vectors["vec_id"], 2000, 512).collect()}
    got = {}
    for r in ann.search(vectors, parts=16, sample=512).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    outside = [q for q in want if q not in seen]
    assert len(outside) > 50
    assert sum(len({i for i, _ in want[q]} & got[q]) for q in outside) >= 0.9 * 20 * len(outside)


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = ann.balanced_parts(x, ann.neighbours(x, 10), 6, rng)
    assert np.bincount(part, minlength=6).max() <= 105
    same = (part[ann.neighbours(x, 10)] == part[:, None]).mean()
    assert same > 0.4  # 1/6 by chance


def test_a_large_fit_takes_little_memory():
    """32,768 vectors and 1,024 parts, what a table of eight million vectors is fitted with, in a process of its own."""
    made = "import resource, numpy as np; from larkspur.llm import ann; x = np.random.default_rng(0).normal(size=(32768, 64)); b = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; ann.fit(x, 1024); print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - b) // 1024)"
    out = subprocess.run([sys.executable, "-c", made], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 1000
