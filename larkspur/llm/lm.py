"""Scores of whole texts by a gated recurrent language model, learned from the training share of the same documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import gru
from larkspur.llm.common import slices, small_batches, split_words, written

#: The network's words: the END of a text, BUCKETS that all other words fall into by their last characters, and the most
#: frequent words. A bucket's share goes to its words by their counts. FREQUENT counts are at hand in every task.
WORDS = gru.SIDE * gru.SIDE
BUCKETS = 63
NAMED = WORDS - BUCKETS - 1
FREQUENT = 200_000
#: Rounds of training, each over its own part of the training texts. Weights that are averaged at once, in a task or on the
#: driver. Lanes of texts that a task reads side by side; bytes of text, and of codes, in a slice.
ROUNDS, FAN, LANES, SLICE, CODES = 3, 64, 512, 16 << 20, 5 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 on division by 5; false for null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def bucket(word: Column) -> Column:
    return F.pmod(F.crc32(F.right(word, F.lit(2)).cast("binary")), F.lit(BUCKETS)).cast("int")


def bucket_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all training texts; only A-Z are lower-cased. A slice's words are counted before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            found = pc.value_counts(split_words(batch.column(0))[0])
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "c"])

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What every task has at hand: counts of frequent words, the network's words, the buckets' masses. Its size is bounded."""

    def __init__(self, counts: DataFrame, n_texts: int):
        # the least power of two from which on at most FREQUENT words are: a row for each power
        total = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("power")).agg(F.count("*").alias("words"), F.sum("c").alias("c")).collect()
        self.n = sum(r["c"] for r in total) + n_texts
        self.v = sum(r["words"] for r in total) + (n_texts > 0)
        self.least, held = 1 << 62, 0
        for r in sorted(total, key=lambda r: -r["power"]):
            held += r["words"]
            if held > FREQUENT:
                break
            self.least = 1 << r["power"]
        rows = counts.where(F.col("c") >= F.lit(self.least)).collect()
        rows.sort(key=lambda r: (-r["c"], r["word"]))
        self.words = pa.array([r["word"] for r in rows], pa.string())
        self.counts = np.array([r["c"] for r in rows], dtype=np.int64)
        named = [r["word"] for r in rows[:NAMED]]
        self.n_named = len(named)
        names = counts.sparkSession.createDataFrame([(w,) for w in named], "word string")
        mass = counts.join(F.broadcast(names), "word", "left_anti").groupBy(bucket(F.col("word")).alias("b")).agg(F.sum(F.col("c") + 0.5).alias("mass"), F.sum("c").alias("c")).collect()
        self.mass = np.full(BUCKETS, 0.5)  # one unseen word in each
        n_of = np.zeros(BUCKETS)
        for r in mass:
            self.mass[r["b"]] += r["mass"]
            n_of[r["b"]] = r["c"]
        # the network's words in order of frequency, so that classes hold words of like frequency
        share = np.concatenate([[n_texts], n_of, self.counts[:NAMED], np.zeros(NAMED - self.n_named)]) + 0.5
        self.place = np.empty(WORDS, np.int16)
        order = np.argsort(-share, kind="stable")
        self.place[order] = np.arange(WORDS)
        self.share = (share / share.sum())[order]
        self.end = int(self.place[0])

    def base(self, c: np.ndarray | int) -> np.ndarray:
        return np.log10(c + 0.5) - np.log10(self.n + 0.5 * (self.v + 1))

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of a batch: where its texts begin, and for each word its count (-1: not at hand), its place in the network's
        words, the log10 of its share of its bucket but for log10(c + 0.5) where that is not at hand; and the words."""
        flat, ends = split_words(texts)
        coded = flat.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.words)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        c = np.where(at >= 0, self.counts[at] if len(self.counts) else 0, -1)
        named = (at >= 0) & (at < self.n_named)
        code, extra = np.empty(len(at), np.int16), np.zeros(len(at))
        code[named] = self.place[1 + BUCKETS + at[named]]
        other = np.flatnonzero(~named)
        if len(other):
            b = np.array([bucket_of(w) for w in coded.dictionary.take(pa.array(other)).to_pylist()])
            code[other] = self.place[1 + b]
            extra[other] = -np.log10(self.mass[b]) + np.where(c[other] >= 0, np.log10(np.maximum(c[other], 0) + 0.5), 0)
        i = coded.indices.to_numpy()
        return ends, c[i], code[i], extra[i], flat


CODED = "row long, doc_id long, n_tokens long, n_known long, base_score double, extra double, rare array<string>, codes binary, turn int"


def coded(docs: DataFrame, vocabulary: Vocabulary, n_texts: int) -> DataFrame:
    """Every text as the network's words, two bytes each, with what needs no network; written once, for all that follows.

    turn: the round that a text trains in, ROUNDS for those held out; each has a folder of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        one = np.log10(v.n + 0.5 * (v.v + 1))
        for batch in slices(batches, most=SLICE):
            ends, c, code, extra, flat = v.read(batch.column(2))
            n = batch.num_rows
            doc = np.repeat(np.arange(n), np.diff(ends))
            rare = c < 0
            sums = lambda x: np.bincount(doc, x, n)
            base = sums(np.where(rare, 0.0, np.log10(np.maximum(c, 0) + 0.5)) - one) + np.log10(n_texts + 0.5) - one
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums(rare))]).astype(np.int32)), flat.filter(pa.array(rare)))
            raw, at = code.astype("<i2").tobytes(), (2 * ends).tolist()
            codes = pa.array([raw[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())
            known = sums(c > 0).astype(np.int64) + (n_texts > 0)
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(ends) + 1), pa.array(known), pa.array(base), pa.array(sums(extra)), lists, codes, batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in CODED.split(", ")])

    turn = F.when(held_out(F.col("doc_id")), ROUNDS).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).cast("int"))
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", turn.alias("turn"))
    return written(keyed.mapInArrow(run, CODED), "coded", by=["turn"])


def read_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a batch, and where each text's begin (one more entry than texts)."""
    at = np.concatenate([[0], np.cumsum(pc.binary_length(column).to_numpy())]) // 2
    return np.frombuffer(b"".join(column.to_pylist()), "<i2"), at


def averaged(found: DataFrame) -> np.ndarray | None:
    """The mean of weights (task, seen, weights) by the words seen. FAN at a time are summed in tasks, until the driver
    gets FAN at most; every level is written, so a lost executor costs no training."""

    def summed(rows: list[tuple]) -> tuple[int, int, bytes]:
        rows = sorted(rows)
        total = sum(n for _, n, _ in rows)
        return rows[0][0], total, sum(np.frombuffer(raw, np.float32).astype(np.float64) * (n / total) for _, n, raw in rows).astype(np.float32).tobytes()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = row if own is None else summed([own, row])
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in own], ["task", "seen", "weights"])

    found = written(found, "weights")
    while (n := found.count()) > FAN:
        found = written(found.repartition(-(-n // FAN)).mapInArrow(merge, "task long, seen long, weights binary"), "weights")
    rows = [tuple(r) for r in found.collect()]
    return np.frombuffer(summed(rows)[2], np.float32) if rows else None


def trained(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The network's weights after one pass over all training texts (coded()), in rounds.

    In each round all tasks start from the same weights and go through their texts of the round; the weights that they
    end with are averaged by the words they saw.
    """
    flat = gru.initial(vocabulary.share)
    sc, end = texts.sparkSession.sparkContext, vocabulary.end
    for turn in range(ROUNDS):
        start, rate = sc.broadcast(flat), 0.015 / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            own, seen = start.value.copy(), 0
            adam = gru.Adam(own, rate)
            for batch in slices(batches, "codes", CODES):
                seen += gru.train(own, adam, gru.Lanes.of(*read_codes(batch.column(0)), end, LANES))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen]), pa.array([own.tobytes()], pa.binary())], ["task", "seen", "weights"])

        mean = averaged(texts.where(F.col("turn") == turn).select("codes").mapInArrow(run, "task long, seen long, weights binary"))
        flat = flat if mean is None else mean
    return flat


def scored(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts are taken over all training texts. The counts of at most FREQUENT words are broadcast; the other words of the
    texts, each rare by that choice, meet their counts in a join. A word that the network has no name for is scored as its
    bucket times its share of the bucket's smoothed counts, so the probabilities of all words add up to one. Null texts are
    empty: just an end. Rows that share a doc_id stay rows of their own; without training texts all counts are zero;
    other columns are ignored, an empty table gives no rows.
    """
    small_batches(docs.sparkSession, 10_000)  # lanes fill better with more texts
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = written(word_counts(docs), "counts")
    n_texts = docs.select("doc_id").where(~held_out(F.col("doc_id"))).count()
    v = Vocabulary(counts, n_texts)
    texts = coded(docs, v, n_texts)
    net, end = docs.sparkSession.sparkContext.broadcast(trained(texts, v)), v.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = gru.unflatten(net.value)
        for batch in slices(batches, "codes", CODES):
            own = gru.score(w, gru.Lanes.of(*read_codes(batch.column(6)), end, LANES), batch.num_rows) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own + batch.column(5).to_numpy())], ["row", "doc_id", "n_tokens", "n_known", "base_score", "score"])

    figures = ["row", "doc_id", "n_tokens", "n_known", "base_score"]
    parts = texts.select(*figures, "extra", "codes").mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    few = counts.where(F.col("c") < F.lit(v.least))
    met = texts.select("row", F.explode("rare").alias("word")).join(few, "word", "left")
    rest = met.groupBy("row").agg(F.count("c").alias("known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log"))
    more = F.coalesce("log", F.lit(0.0))
    return parts.join(rest, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(v.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
