"""Near duplicates by circulant MinHash, banding, and exact Jaccard on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import hot_join, slices, small_batches, split_words, written
from larkspur.llm.components import components

#: Places of the two permutations, bands, coordinates of a band. With independent coordinates a pair of similarity 0.75
#: would share none of 48 bands of 4 with a probability of (1 - 0.75 ** 4) ** 48 = 1e-8, and fewer than two with 3e-7.
PLACES, BANDS, ROWS = 1 << 20, 48, 4
#: Hubs that a member is compared with, those it shares most buckets with; other links are found across components.
HUBS = 6
#: So many ids, or hashes with their counts, at most are broadcast, 8 or 16 bytes each; above, the join is dealt out.
BROADCAST_IDS = 2_000_000
#: A hash that fewer sets have is rare: what is compared for it needs no order.
FREQUENT = 8
M = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct k-word shingles; of all its words where it has fewer."""
    import xxhash

    flat, ends = split_words(texts)
    coded = flat.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()] or [0], dtype=np.uint64)
    code = own[coded.indices.to_numpy()]
    n = len(code)
    rolled = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for i in range(k):
        rolled = rolled * M + code[i : i + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if a == b:
            out.append(rolled[:0])
        elif b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        else:
            whole = np.array([b - a], dtype=np.uint64)
            for x in code[a:b]:
                whole = whole * M + x
            out.append(mixed(whole))
    return out


class Circulant:
    """Signatures from two permutations: the first gives a shingle its place, the second is read from that place on.

    Coordinate k is the least value that the second permutation, shifted by k places, has over a set; so the values of
    one shingle for all coordinates lie side by side.
    """

    def __init__(self, places: int = PLACES, bands: int = BANDS, rows: int = ROWS, seed: int = 20):
        rng = np.random.default_rng(seed)
        values = rng.permutation(places).astype(np.uint32)
        k = bands * rows
        self.read = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: k - 1]]), k)
        self.shift = np.uint64(64 - (places - 1).bit_length())
        self.salt = rng.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
        self.bands, self.rows = bands, rows

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        place = ((hashes * self.salt) >> self.shift).astype(np.int64)
        best = None
        for at in range(0, len(place), 4096):
            part = self.read[place[at : at + 4096]].min(axis=0)
            best = part if best is None else np.minimum(best, part)
        return best

    def buckets(self, hashes: np.ndarray) -> np.ndarray:
        """A 64-bit name for each band of the signature."""
        sig = self.signature(hashes).reshape(self.bands, self.rows).astype(np.uint64)
        name = np.arange(1, self.bands + 1, dtype=np.uint64)
        for i in range(self.rows):
            name = mixed(name * M + sig[:, i])
        return name.view(np.int64)


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, print, buckets); print is a 128-bit digest of the set, null where the set is empty."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        circulant = Circulant()
        for batch in slices(batches):
            sets = shingle_sets(batch.column(1), k)
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            names = [circulant.buckets(s) if len(s) else np.empty(0, np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int32)), pa.array(np.concatenate(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), lists], ["doc_id", "n_shingles", "print", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "doc_id long, n_shingles long, print binary, buckets array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents in wanted (id)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1), k)], pa.binary())], ["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(bounded(wanted), "id", "left_semi")
    return texts.mapInArrow(made, "id long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def bounded(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is small: it holds ids, and its rows are counted."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def frequencies(sets: DataFrame) -> DataFrame:
    """(h, c): how many of all sets have a hash, for those that FREQUENT or more have. Counted by batch, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h, c = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int32))], ["h", "c"])

    return sets.select("set").mapInArrow(count, "h long, c int").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, left, before, h): of every set the hashes of which two sets that are to be linked must share one.

    left: how many hashes of the set there are from this one on, itself included. before: the hash before it, or null.

    All sets are put in one order, by the number of sets that have a hash, the most frequent last; two sets with
    100 * intersection >= percent * union then share one of the first n - ceil(percent * n / 100) + 1 of each. The
    counts are broadcast up to BROADCAST_IDS of them; more are met in a join by hash.
    """
    often = written(frequencies(sets), "frequencies")
    if often.count() > BROADCAST_IDS:
        return _prefixes_by_join(sets, often, percent)
    table = often.toArrow().sort_by("h")
    names, counts = table["h"].to_numpy(), table["c"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast((names, counts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = shared.value
        for batch in batches:
            ids, sizes, left, heads, previous = [], [], [], [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                n = len(own)
                rank = np.zeros(n, np.int64)
                if len(names):
                    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                    rank = np.where(names[at] == own, counts[at], 0)
                first = own[np.lexsort((own, rank))[: n + (-percent * n) // 100 + 1]]
                ids.append(np.full(len(first), i))
                sizes.append(np.full(len(first), n))
                left.append(n - np.arange(len(first)))
                heads.append(first)
                previous.append(np.concatenate([[0], first[:-1]]))
            if ids:
                at = np.concatenate([np.arange(len(x)) for x in heads])
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, sizes, left)]
                before = pa.array(np.concatenate(previous).astype(np.int64), mask=at == 0)
                yield pa.RecordBatch.from_arrays([*columns, before, pa.array(np.concatenate(heads))], ["id", "n", "left", "before", "h"])

    return sets.select("id", "set").mapInArrow(cut, "id long, n long, left long, before long, h long")


def _prefixes_by_join(sets: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """prefixes() where the counts are too many to broadcast: every hash meets its count, then a set is put in order."""

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)], pa.list_(pa.int64()))], ["id", "hs"])

    every = written(sets.select("id", "set").mapInArrow(apart, "id long, hs array<long>").select("id", F.explode("hs").alias("h")), "hashes")
    ranked = hot_join(every, often, "h").select("id", F.struct(F.coalesce("c", F.lit(0).cast("long")).alias("c"), "h").alias("x"))
    ordered = ranked.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("hs")).withColumn("n", F.size("hs").cast("long"))
    first = F.slice("hs", F.lit(1), (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).cast("int"))
    dealt = ordered.select("id", "n", F.col("hs").alias("every"), F.posexplode(first).alias("at", "x"))
    return dealt.select("id", "n", (F.col("n") - F.col("at")).alias("left"), F.get("every", F.col("at") - 1)["h"].alias("before"), F.col("x.h").alias("h"))


def between(heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of different components that may be linked by their sizes and the first hash they share.

    heads: id, n, left, before, h, c. If a hash is the first in the order that two sets share, what is left of either
    bounds what they share; so a pair that cannot be linked by that bound, or that shares the hash before as well, is
    left to its first. Members of a hash's most frequent component are only met from outside it, so what is looked at
    for a hash does not grow with the square of a component.
    """
    several = heads.groupBy("h").agg(F.mode("c").alias("big"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").drop("lo", "hi")
    heads = written(heads.join(several, "h"), "heads")
    minor = heads.where("c <> big").select("h", F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("left").alias("leftx"), F.col("before").alias("beforex"))
    fits = (F.col("c") != F.col("cx")) & ((F.col("c") == F.col("big")) | (F.col("x") > F.col("id"))) & (100 * F.least("n", "nx") >= percent * F.greatest("n", "nx"))
    fits &= (100 + percent) * F.least("left", "leftx") >= percent * (F.col("n") + F.col("nx"))
    fits &= F.coalesce(F.col("before") != F.col("beforex"), F.lit(True))
    met = minor.join(heads, "h").where(fits)
    return met.select(F.greatest("x", "id").alias("a"), F.least("x", "id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    Equal sets are one class first; only its least doc_id goes on. In every bucket the members are compared with one of
    them, the hub, not with each other: each with up to HUBS hubs that it shares two buckets or more with. What turns
    out linked is one component. Then the members of buckets with several are compared across components, wherever they share a
    hash that a link between them would need. So no link between components is left out, and within a component none
    is needed. All comparisons are on whole sets.

    A null doc_id or a text without words is linked with nothing: its component is its own doc_id, it is kept. Rows that
    share a doc_id are one node. Other columns are ignored. No documents give no rows.
    """
    small_batches(docs.sparkSession)
    every = written(signatures(docs, k), "signatures")
    signed = every.where("print is not null and doc_id is not null")
    classes = written(signed.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("buckets").alias("buckets")), "classes")
    names = classes.select("rep", F.explode("buckets").alias("bucket"))
    shared = names.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top").drop("top")
    votes = names.join(shared, "bucket").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    # a member has at most as many hubs as there are bands
    ranked = F.array_sort(F.collect_list(F.when((F.col("rep") != F.col("hub")) & (F.col("n") > 1), F.struct((-F.col("n")).alias("n"), "hub"))))
    members = written(votes.groupBy("rep").agg(F.transform(F.slice(ranked, 1, HUBS), lambda x: x["hub"]).alias("hubs")), "members")

    sets = written(sets_of(docs, members.select(F.col("rep").alias("id")), k), "sets", compression="uncompressed")
    tried = members.select(F.col("rep").alias("a"), F.explode("hubs").alias("b"))
    links = written(confirmed(tried, sets, percent), "links")
    found = components(links)

    heads = prefixes(sets, percent).join(bounded(found.select(F.col("node").alias("id"), F.col("component").alias("c"))), "id", "left")
    pairs = between(heads.withColumn("c", F.coalesce("c", "id")), percent).join(tried, ["a", "b"], "left_anti")
    more = written(confirmed(pairs, sets, percent), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    classed = signed.select("doc_id", "n_shingles", "print").join(classes.select("print", "rep"), "print")
    joined = classed.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = every.where("print is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
