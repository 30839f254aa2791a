"""Byte-level BPE over rank files: long texts are encoded in overlapping chunks that are stitched where they agree."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import slices, small_batches


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str):
    """A tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def boundaries(text: str, match) -> np.ndarray:
    """Where pre-tokens end after a character that is not white space. Matching from there on needs nothing before it."""
    return np.array([e for m in match(text) if not text[(e := m.end()) - 1].isspace()], dtype=np.int32)


def agreed(own: np.ndarray, following: np.ndarray, start: int, overlap: int) -> int | None:
    """The first pre-token end that a chunk and the next one, which begins at `start`, both have in the stretch they share
    (bar its last characters, where a pre-token may be cut off); null without one."""
    shared = np.intersect1d(own[own > start], following, assume_unique=True)
    return int(shared[0]) if len(shared) and shared[0] < start + overlap - 8 else None


def stitched(text: str, match, chunk: int, overlap: int) -> list[str]:
    """The pieces of a text: chunks, each with the first `overlap` characters of what follows, are cut into pre-tokens on
    their own, and neighbours are cut apart where they agree. Those that have no such end stay one piece."""
    if len(text) <= chunk:
        return [text]
    starts = range(0, len(text), chunk)
    ends = [boundaries(text[s : s + chunk + overlap], match) + s for s in starts]
    cuts = [agreed(a, b, s, overlap) for a, b, s in zip(ends, ends[1:], starts[1:], strict=False)]
    at = [0, *[c for c in cuts if c is not None], len(text)]
    return [text[a:b] for a, b in zip(at, at[1:], strict=False) if a < b]


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = 1 << 12, overlap: int = 1 << 8, slab: int = 1 << 18) -> DataFrame:
    """The ids of every whole text (null: empty), as (doc_id, pieces array of binary little-endian uint32 ids).

    Every text above `chunk` characters goes through stitched(): its chunks find their own pre-tokens, the text is cut where
    neighbours resynchronise, and the pieces are encoded. Texts of up to `slab` characters are chunked in the task that
    reads them. A longer one is cut into slabs with the same overlap, which are dealt out to tasks, find their own
    pre-tokens and are stitched in the same way by a window over the text's slabs; the pieces that come of it are
    dealt out again, and chunked where they are encoded. Where neighbours have no common end - a pre-token longer than the
    overlap - they form one piece. Rows with the same doc_id stay rows of their own; an empty table gives no rows; other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def encoder():
        import regex

        enc, match = encoding(ranks, pattern), regex.compile(pattern).finditer
        return lambda text: [np.array(enc.encode_ordinary(x), dtype="<u4").tobytes() for x in stitched(text, match, chunk, overlap)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(ids, batch.column(1).to_pylist())), pa.list_(pa.binary()))], ["doc_id", "pieces"])

    short = keyed.where(F.length("text") <= slab).mapInArrow(whole, "doc_id long, pieces array<binary>")

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part, at in enumerate(range(0, len(text), slab)):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([doc], pa.int64()), pa.array([part], pa.int32()), pa.array([text[at : at + slab + overlap]])], ["row", "doc_id", "part", "text"])

    long = keyed.where(F.length("text") > slab).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = long.mapInArrow(slabs, "row long, doc_id long, part int, text string").repartition("row", "part")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        match = regex.compile(pattern).finditer
        for batch in slices(batches, most=1 << 20):
            found = [boundaries(x, match) for x in batch.column(3).to_pylist()]
            head = [[x for x in f[f < overlap - 8].tolist()] for f in found]
            tail = [[x - slab for x in f[(f > slab) & (f < slab + overlap - 8)].tolist()] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], [*batch.schema.names, "head", "tail"])

    found = cut.mapInArrow(ends, "row long, doc_id long, part int, text string, head array<int>, tail array<int>")
    w = Window.partitionBy("row").orderBy("part")
    sync = F.array_min(F.array_intersect(F.lag("tail").over(w), F.col("head")))  # in characters of this chunk
    cuts = found.withColumn("first", sync).withColumn("next", F.lead("first").over(w)).withColumn("has_next", F.lead("part").over(w).isNotNull())
    # a chunk's own text: from its own cut to the next one's; without a cut the piece goes on
    own = F.when(F.col("part") == 0, 0).otherwise(F.coalesce("first", F.lit(0)))
    upto = F.when(~F.col("has_next"), F.length("text")).otherwise(F.lit(slab) + F.coalesce("next", F.lit(0)))
    pieces = (
        cuts.withColumn("piece", F.sum(F.when((F.col("part") == 0) | F.col("first").isNotNull(), 1).otherwise(0)).over(w))
        .select("row", "doc_id", "part", "piece", F.col("text").substr(own + 1, upto - own).alias("text"))
        .groupBy("row", "doc_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([b"".join(ids(x)) for x in batch.column(3).to_pylist()], pa.binary())], ["row", "doc_id", "piece", "ids"])

    joined = (
        pieces.mapInArrow(encoded, "row long, doc_id long, piece long, ids binary")
        .groupBy("row", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"]).alias("pieces"))
        .select("doc_id", "pieces")
    )
    return short.unionByName(joined)


def digests(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; decoding puts the raw bytes of the ids one after another."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        raw = np.empty(enc.n_vocab, dtype=object)
        for b in enc.token_byte_values():
            raw[enc.encode_single_token(b)] = b
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [b"".join(x) for x in part.column(1).to_pylist()]
                back = [hashlib.sha256(b"".join(raw[np.frombuffer(x, dtype="<u4")])).hexdigest() for x in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rows]), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
