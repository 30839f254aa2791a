"""Bounded-space online best-fit packing of documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch_rows, encoder, slices, written


class BestFit:
    """At most `most` open bins. Bit f of `bits` tells that some open bin has f places free."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]  # by free places, bins as numbers

    def put(self, length: int) -> tuple[int, int]:
        """The bin of an item of 1 to `size` places and its offset there: the open bin with the least room that will do."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.size
            self.made += 1
        if free > length:
            self.bins[free - length].append(number)
            self.bits |= 1 << (free - length)
            self.open += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def left(self) -> list[tuple[int, int]]:
        """(bin, places used) of the bins that are still open."""
        return [(b, self.size - free) for free in range(1, self.size + 1) for b in self.bins[free]]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, open_bins: int = 64, group: int = 256) -> DataFrame:
    """A row for every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the round (1
    or 2) that placed it.

    Each task encodes the texts that it reads (null: empty), adds end_id, cuts what is longer than `size` and puts the
    pieces as they come into its own open bins, of which there are `open_bins` at most: the fullest closes. What is still open
    at its end, so many bins at most, goes through a second round: the tasks are taken in turn, so that about `group` bins come
    together, and their pieces are put, bin by bin and in the order in which they came, into as many open bins again. They stay as
    they were where that takes no fewer bins. So neither round has a task that grows with the input, and the share of
    pieces in the second falls with the size of a task. Rows with the same doc_id stay rows of their own,
    a null doc_id stays null, other columns are ignored, no documents give no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, drops_space=True)
        fit, part, end = BestFit(size, open_bins), TaskContext.get().partitionId(), np.array([end_id], dtype="<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
        rows: list[tuple] = []
        for batch in slices(batches):
            ids, cut = enc.encode(batch.column(1))
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            for k, doc in enumerate(batch.column(0).to_pylist()):
                first, n = int(cut[k]), int(cut[k + 1] - cut[k]) + 1
                for piece, start in enumerate(range(0, n, size)):
                    length = min(size, n - start)
                    last = start + length == n
                    crc = zlib.crc32(raw[4 * (first + start) : 4 * (first + start + length - last)])
                    number, offset = fit.put(length)
                    rows.append((doc, piece, start, length, zlib.crc32(end, crc) if last else crc, part, number, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
        if left := fit.left():  # a row without a piece for each, numbered in the place of its start
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(None, None, k, used, None, part, b, None) for k, (b, used) in enumerate(left)], strict=True), kinds, strict=True)], names)

    with batch_rows(docs.sparkSession, 2000):
        packed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, PIECES), "pieces")
    packed = packed.withColumn("own", F.col("part") * F.lit(1 << 40) + F.col("bin"))
    number = F.col("part") * F.lit(open_bins) + F.col("start")
    left = packed.where(F.col("piece").isNull()).select("own", F.floor(number / F.lit(max(group, open_bins))).alias("g"))
    found = packed.where(F.col("piece").isNotNull()).join(left, "own", "left")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    closed = found.where(F.col("g").isNull()).select(*columns, F.col("own").alias("sequence_id"), "offset", F.lit(1).alias("round"))

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["own", "offset"]).reset_index(drop=True)
        bins = sorted(rows["own"].unique())
        fit = BestFit(size, open_bins)
        placed = [fit.put(int(n)) for n in rows["length"]]
        if fit.made < len(bins):
            rows["own"], rows["offset"] = [bins[b] for b, _ in placed], [o for _, o in placed]
        return rows[[*columns, "own", "offset"]].rename(columns={"own": "sequence_id"}).assign(round=2)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, round int"
    opened = found.where(F.col("g").isNotNull()).groupBy("g").applyInPandas(lambda x: again(x[[*columns, "own", "offset"]]), kinds)
    return closed.unionByName(opened)
