"""Whitening of embeddings: covariances by Chan's merging, eigenvectors on the driver, and a second pass that checks them.

Entries are counted in whole numbers (floor(1024 * c) + 100000), so sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch_rows, written

SCALE, SHIFT = 1024, 100_000
#: Entries from here on do not become whole numbers, as sums over a batch could not be exact.
MOST = 2.0**38
#: Eigenvalues below this share of the trace are noise of the arithmetic: nothing is divided by their roots.
FLAT = 1e-13


class Moments:
    """How many vectors there are, their exact sums, and their scatter about their own mean."""

    def __init__(self, n: int, sums: list, scatter: np.ndarray):
        self.n, self.sums, self.scatter = n, sums, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of x, which are whole numbers or, in the second pass, real ones."""
        n, sums = len(x), x.sum(axis=0)
        centred = x - sums / n
        return cls(n, sums.tolist(), centred.T @ centred)

    def merge(self, other: Moments) -> Moments:
        """Of both: the scatters, and what their means lie apart (Chan, Golub and LeVeque)."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        # the means' difference from whole numbers, so that nothing is lost however large the sums are
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


NONE = Moments(0, [], np.zeros((0, 0)))


def _rows(column: pa.Array, d: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d).astype(kind, copy=False)


def moments(vectors: DataFrame, d: int, column: str = "x", kind=np.int64) -> Moments:
    """Of an array column of d entries over all rows. Each task merges its batches, tasks are merged in a tree of so many
    levels that the driver gets the last few, each of d * d numbers."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NONE
        for batch in batches:
            if batch.num_rows:
                own = own.merge(Moments.of(_rows(batch.column(0), d, kind)))
        if own.n:
            # sums as text: whole numbers of any size
            yield pa.RecordBatch.from_arrays([pa.array([own.n]), pa.array([list(map(repr, own.sums))]), pa.array([own.scatter.tobytes()])], ["n", "sums", "scatter"])

    number = int if kind is np.int64 else float
    parts = vectors.select(column).mapInArrow(local, "n long, sums array<string>, scatter binary").rdd.map(lambda r: Moments(r["n"], list(map(number, r["sums"])), np.frombuffer(bytes(r["scatter"])).reshape(d, d)))
    depth = max(2, ceil(log(max(parts.getNumPartitions(), 2), 4)))
    return parts.treeAggregate(NONE, Moments.merge, Moments.merge, depth)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long) of the vectors that take part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(MOST)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + SHIFT).alias("x"))


def principal(m: Moments, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The `most` largest eigenvalues of the covariance, their unit eigenvectors as columns, and the trace."""
    cov = m.scatter / m.n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    axes = axes[:, order]
    # the sign that makes the largest entry positive, so that it does not depend on the library
    return values[order], axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0), float(np.trace(cov))


def whitened(vectors: DataFrame, most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, exact_deviation: a row for each vector and component.

    Vectors that are null, empty, or hold null or non-finite entries or entries of 2 ** 38 and more take no part, nor do
    those whose length is not the commonest (of equally common ones the longest). All others fit and are projected: x is
    floor(1024 * c) + 100000; components are the covariance's eigenvectors by falling eigenvalue, `most` of them or as many
    as there are entries. `deviation` is null where it does not fit a long; `exact_deviation` is the same as a decimal.
    `whitened` is null for a component without variance (equal vectors, or fewer vectors than components), which has no
    part in identity_error either. Rows that share a vec_id, or have none, stay rows of their own; other columns have no
    part in it; no vectors give no rows.
    """
    spark = vectors.sparkSession
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, exact_deviation decimal(38,0)"
    with batch_rows(spark, 2000):
        every = written(whole_numbers(vectors), "whole")
        length = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).head()
        if length is None:
            return spark.createDataFrame([], kinds)
        d = length["d"]
        x = every.where(F.size("x") == d)
        m = moments(x, d)
        values, axes, trace = principal(m, min(most, d))
        real = values > FLAT * max(trace, 1.0)
        root = np.where(real, np.sqrt(np.maximum(values, 0)), 1.0)
        mean, n, sums = np.array([s / m.n for s in m.sums]), m.n, m.sums
        explained = values / trace if trace > 0 else np.zeros(len(values))

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _rows(batch.column(1), d, np.int64)
                if not len(rows):
                    continue
                most_apart = n * int(np.abs(rows - np.array([s // n for s in sums], dtype=np.int64)).max() + 1)
                if d * most_apart**2 < 1 << 63 and n * int(np.abs(rows).max()) < 1 << 62:
                    deviation = ((n * rows - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in rows.tolist()]
                white = ((rows - mean) @ axes) / root
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(white.tolist(), pa.list_(pa.float64())), pa.array(list(map(str, deviation)))], ["vec_id", "white", "said"])

        projected = written(x.mapInArrow(project, "vec_id long, white array<double>, said string"), "white")
        second = moments(projected, len(values), "white", np.float64)
    cov = second.scatter / second.n
    off = np.abs(cov - np.eye(len(cov)))[np.ix_(real, real)]
    error = float(off.max()) if off.size else 0.0
    exact = F.col("said").try_cast("decimal(38,0)")
    at = lambda a: F.get(F.array(*[F.lit(float(v)) for v in a]), F.col("k"))
    has = F.get(F.array(*[F.lit(bool(b)) for b in real]), F.col("k"))
    out = projected.select("vec_id", "said", F.posexplode("white").alias("k", "w"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("said").try_cast("long").alias("deviation"), F.when(has, F.col("w")).alias("whitened"),
        at(explained).alias("explained"), F.lit(error).alias("identity_error"), exact.alias("exact_deviation"),
    )
