"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts; a small classifier learns which part a vector's
neighbours lie in; every vector is filed under its most probable part, and a query looks into several.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import sampled, written


#: Queries that are compared at once, rows of any matrix of scores that the driver holds, and the most parts.
TILE, ROWS, MOST_PARTS = 512, 256, 1024


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest others of each row (of the rows `of`, if given) by inner product, in blocks of rows."""
    of = np.arange(len(x)) if of is None else of
    k = min(k, len(x) - 1)
    out = np.empty((len(of), k), np.int64)
    for at in range(0, len(of), ROWS):
        own = of[at : at + ROWS]
        s = -(x[own] @ x.T)
        s[np.arange(len(own)), own] = np.inf
        out[at : at + ROWS] = np.argpartition(s, k - 1, axis=1)[:, :k]
    return out


def _nearest_centre(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre with the largest inner product of each row, and that product, in blocks of rows."""
    near, best = np.empty(len(x), np.int64), np.empty(len(x))
    for at in range(0, len(x), ROWS):
        s = x[at : at + ROWS] @ centre.T
        near[at : at + ROWS] = s.argmax(axis=1)
        best[at : at + ROWS] = s.max(axis=1)
    return near, best


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each node so that few edges are cut and no part has over slack times the mean.

    It starts from nodes filed under the nearest of random centres in order of their margin. In each round every node
    moves to the part that most of its neighbours, both ways, are in, as long as there is room. Nothing that is held has a
    row for each node and a column for each part.
    """
    n = len(x)
    room = int(np.ceil(slack * n / parts))
    centre = x[rng.choice(n, parts, replace=False)]
    for _ in range(4):
        near, _ = _nearest_centre(x, centre)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=parts) == 0
        total[empty] = x[rng.integers(n, size=int(empty.sum()))]
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    _, margin = _nearest_centre(x, centre)
    part, size, full = np.full(n, -1), np.zeros(parts, np.int64), np.zeros(parts)
    for i in np.argsort(-margin):
        p = int(np.argmax(centre @ x[i] + full))
        part[i] = p
        size[p] += 1
        full[p] = -np.inf if size[p] >= room else 0
    rows, cols = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([rows, cols]), np.concatenate([cols, rows])
    for _ in range(rounds):
        # how many neighbours of a node are in a part, only where there are some
        key, count = np.unique(a * parts + part[b], return_counts=True)
        node, there = key // parts, key % parts
        order = np.lexsort((there, -count, node))
        first = order[np.concatenate([[True], np.diff(node[order]) > 0])] if len(order) else order
        best, most = part.copy(), np.zeros(n, np.int64)
        best[node[first]], most[node[first]] = there[first], count[first]
        own = np.zeros(n, np.int64)
        mine = part[node] == there
        own[node[mine]] = count[mine]
        gain = most - own
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[best[i]] < room:
                size[part[i]] -= 1
                part[i] = best[i]
                size[part[i]] += 1
                moved += 1
        if not moved:
            break
    return part


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128, epochs: int = 25, rate: float = 3e-3) -> list[np.ndarray]:
    """Weights of a network with one hidden layer that tells how a vector's neighbours spread over the parts (Adam).

    target: for each row the parts of its neighbours and its own, which weigh the same.
    """
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            d = softmax(h @ w[2] + w[3])
            np.subtract.at(d, (np.arange(len(i))[:, None], target[i]), 1 / target.shape[1])
            d /= len(i)
            back = (d @ w[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((x[i].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[j] += 0.1 * (g - m[j])
                v[j] += 0.001 * (g * g - v[j])
                w[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class Router:
    weights: list[np.ndarray]
    parts: int
    probes: int

    def ranked(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, the most probable first."""
        if len(x) > 4 * ROWS:
            return np.concatenate([self.ranked(x[at : at + 4 * ROWS], n) for at in range(0, len(x), 4 * ROWS)])
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.maximum(unit @ self.weights[0] + self.weights[1], 0) @ self.weights[2] + self.weights[3]
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def fit(sample: np.ndarray, parts: int, graph_k: int = 10, k: int = 20, recall: float = 0.95, seed: int = 7) -> Router:
    """A router from sample rows, all but a tenth, which the graph and the network never see. Probes: the fewest by which
    that tenth find `recall` of their k nearest among all rows."""
    rng = np.random.default_rng(seed)
    unit = (sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)).astype(np.float64)
    held = np.arange(len(sample)) % 10 == 0
    x = unit[~held]
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return Router([np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], 1, 1)
    graph = neighbours(x, graph_k)
    part = balanced_parts(x, graph, parts, rng)
    router = Router(train_router(x, np.concatenate([part[graph], part[:, None]], axis=1), parts, rng), parts, parts)
    home, asked = router.ranked(sample, 1)[:, 0], np.flatnonzero(held)
    near = neighbours(sample, k, asked)
    place = np.argsort(router.ranked(sample[asked], parts), axis=1)  # how many probes reach a part
    reached = place[np.arange(len(near))[:, None], home[near]]
    share = [(reached < p).mean() for p in range(1, parts + 1)]
    router.probes = next((p for p, s in enumerate(share, 1) if s >= recall), parts)
    return router


def single(vectors: DataFrame) -> DataFrame:
    """One row for a vec_id: of several, the one whose vector is the least, component by component.

    Only ids are counted; vectors move only where an id is repeated.
    """
    repeated = written(vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return vectors
    least = vectors.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v"))
    return vectors.join(repeated, "vec_id", "left_anti").unionByName(least)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double): vectors without null or non-finite components that are not all zero."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)


def _block(batch_column: pa.Array) -> np.ndarray:
    flat = batch_column.combine_chunks() if isinstance(batch_column, pa.ChunkedArray) else batch_column
    return np.frombuffer(b"".join(flat.to_pylist()), dtype="<f8").reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): the k largest inner products of each query, ties to smaller ids, itself excluded.

    A matrix product finds those that may be among the k; their scores are then summed component by component in one
    order, so equal vectors have equal scores wherever they stand.
    """
    if len(q) > TILE:
        found = [nearest(q_ids[i : i + TILE], q[i : i + TILE], c_ids, c, k) for i in range(0, len(q), TILE)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    s = q @ c.T
    s[q_ids[:, None] == c_ids[None, :]] = -np.inf
    n = min(k, len(c_ids))
    least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
    scale = np.linalg.norm(q, axis=1) * np.linalg.norm(c, axis=1).max()
    row, col = np.nonzero((s >= (least - 1e-9 * scale)[:, None]) & np.isfinite(s))
    score = np.zeros(len(row))
    for d in range(q.shape[1]):
        score += q[row, d] * c[col, d]
    order = np.lexsort((c_ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < n
    return q_ids[row[keep]], c_ids[col[keep]], score[keep]


def search(vectors: DataFrame, every: int = 20, k: int = 20, parts: int = 48, part_rows: int = 8192, sample: int = 8192, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by `every`, the k nearest found.

    There is a part for every `part_rows` vectors, `parts` at least and MOST_PARTS at most. The router is fitted on at most
    `sample` vectors, or 32 for each part, those with the least hashes of their ids; every vector is filed. What looks into
    a part is compared with it in blocks of at most `block` vectors and as many queries, so a part that holds a third of all
    vectors is many tasks, and up to `block` queries a part no vector is copied. Vectors that are null, zero, hold null
    or non-finite components or differ in length from most of the sample take no part. Rows that share a vec_id are one
    vector, see single(); other columns are ignored; no vectors give no rows.
    """
    good = single(usable(vectors))
    total = vectors.count()
    parts = max(parts, min(MOST_PARTS, total // part_rows))
    rows = sampled(good, F.col("vec_id"), total, max(sample, 32 * parts)).collect()
    length = max((sizes := [len(r["v"]) for r in rows]), key=sizes.count, default=0)
    chosen = np.array([r["v"] for r in rows if len(r["v"]) == length], dtype=np.float64).reshape(-1, max(length, 1))
    spark = vectors.sparkSession
    if not len(chosen):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit(chosen, parts, k=k)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)
            best = router.ranked(x, router.probes).astype(np.int32)
            asked = batch.column(0).to_numpy() % every == 0
            probes = [b.tolist() if a else [] for a, b in zip(asked, best, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(best[:, 0]), pa.array(probes, pa.list_(pa.int32()))], ["vec_id", "raw", "part", "probes"])

    filed = written(good.where(F.size("v") == length).mapInArrow(file, "vec_id long, raw binary, part int, probes array<int>"), "filed")
    # a count for each part: so many rows as there are parts
    n_of = {r["part"]: r["n"] for r in filed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    q_of = {r["part"]: r["n"] for r in filed.select(F.explode("probes").alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = F.array(*[F.lit(-(-n_of.get(p, 0) // block)) for p in range(router.parts)])
    q_blocks = F.array(*[F.lit(-(-q_of.get(p, 0) // block)) for p in range(router.parts)])
    nb, nq = F.get(blocks, F.col("part")), F.get(q_blocks, F.col("part"))

    def upto(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    c = filed.where(nq > 0).select("part", F.pmod(F.xxhash64("vec_id"), nb).cast("int").alias("cb"), upto(nq).alias("qb"), "vec_id", "raw")
    q = filed.where(F.size("probes") > 0).select(F.col("vec_id").alias("query_id"), "raw", F.explode("probes").alias("part")).where(nb > 0)
    q = q.select("part", upto(nb).alias("cb"), F.pmod(F.xxhash64("query_id"), nq).cast("int").alias("qb"), "query_id", "raw")

    def rank(queries: pa.Table, found: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not queries.num_rows or not found.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        cols = nearest(queries["query_id"].to_numpy(), _block(queries["raw"]), found["vec_id"].to_numpy(), _block(found["raw"]), k)
        return pa.table([pa.array(x) for x in cols], names=names)

    keys = ["part", "cb", "qb"]
    hits = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
