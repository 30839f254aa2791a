"""Token ids in fixed-width bit packing.

A packed file is a Parquet table with a row per block. A block holds so many ids, each in `width` bits (the least that hold
every id of the vocabulary), least significant bit first, one after another without gaps; only a shard's last block may have
fewer. Documents go on from block to block, so however long one is no block is larger. `at` has where each document's ids begin
in the block (and one more entry, its end), so they lie in bits at[k] * width to at[k + 1] * width: numpy unpacks a block at once,
or any run of ids of it alone. `first` numbers the block's first document within its shard, and `into` tells how many of its
ids lie in earlier blocks. Spark's own writer commits the files, so a lost executor leaves nothing half written and any store
that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import batch_rows, encoder, slices, written

BLOCKS = "shard int, block int, width int, n_ids long, first long, into long, payload binary, doc_id array<long>, at array<long>"


def width_of(vocabulary: int) -> int:
    """The least bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """ids below 2 ** width as bits, least significant first; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop (exclusive) of a packed block, as uint32; only their bytes are touched."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", stop - start, start * width // 8).astype("<u4")
    first = start * width // 8
    raw = np.frombuffer(payload, np.uint8, (stop * width + 7) // 8 - first, first)
    skip = start * width - first * 8
    bits = np.unpackbits(raw, bitorder="little")[skip : skip + (stop - start) * width].reshape(-1, width)
    return (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_packed(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = 1 << 16) -> DataFrame:
    """Encodes every text (null: empty), adds end_id to each and writes the ids as blocks, in ascending doc_id order.

    Texts are dealt out by ranges of doc_id before they are encoded, so that Spark's sample for the ranges costs no
    encoding. A block has block_ids ids. Rows with the same doc_id stay rows of
    their own, one after another in an order that their texts give; a null doc_id comes first. Ranges are cut within a
    doc_id too, so one that very many rows have is many tasks. Other columns are ignored. No documents: an empty table.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = width_of(max(enc.tok.get_vocab_size(), end_id + 1))
        shard, block, doc_number = TaskContext.get().partitionId(), 0, -1
        parts: list[np.ndarray] = []
        names: list[int | None] = []
        at, first, into = [0], 0, 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            cols = ([shard], [block], [width], [len(ids)], [first], [into], [pack(ids, width)], [names], [at])
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        end = np.array([end_id], dtype="<u4")
        for batch in slices(batches):
            ids, cut = enc.encode(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                own, done, doc_number = ids[cut[k] : cut[k + 1]], 0, doc_number + 1
                own = np.concatenate([own, end])
                while done < len(own):
                    if not names:
                        first, into = doc_number, done
                    piece = own[done : done + block_ids - at[-1]]
                    parts.append(piece)
                    names.append(doc)
                    at.append(at[-1] + len(piece))
                    done += len(piece)
                    if at[-1] == block_ids:
                        yield row()
                        parts, names, at, block = [], [], [0], block + 1
        if names:
            yield row()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    with batch_rows(docs.sparkSession, 2000):
        return written(ordered.mapInArrow(encode, BLOCKS), "packed", **{"compression": "uncompressed"})


#: What is known of a document before its place among all is.
JOINED = "shard int, block int, doc_id long, in_block long, n_tokens long, ids_crc32 long"


def read_packed(blocks: DataFrame) -> DataFrame:
    """A row per document of packed blocks: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The shards' totals are summed up on the driver: a row for each file, not for each document. Of a document that goes on from
    block to block only its pieces' lengths and check sums come together.
    """
    totals = blocks.groupBy("shard", "block").agg(F.sum("n_ids").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    base, offsets = 0, []
    for shard, n in sorted((r["shard"], r["n"]) for r in totals.collect()):
        offsets.append((shard, base))
        base += n
    spark = blocks.sparkSession
    shards = spark.createDataFrame(offsets, "base_shard int, base long")
    kinds = "shard int, block int, number long, doc_id long, in_block long, into long, n_tokens long, ids_crc32 long, whole boolean"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, ids = r["at"], unpack(r["payload"], r["width"], 0, r["n_ids"])
                raw = memoryview(ids.tobytes())
                n = len(r["doc_id"])
                # what is cut by the block's ends: its first document if that began earlier, its last if the next block has more of it
                whole = [not (k == 0 and r["into"]) and not (k == n - 1 and r["open"]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["shard"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(range(r["first"], r["first"] + n), pa.int64()), pa.array(r["doc_id"], pa.int64()), pa.array(at[:-1], pa.int64()),
                    pa.array([r["into"]] + [0] * (n - 1), pa.int64()), pa.array([b - a for a, b in zip(at, at[1:], strict=False)], pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)], pa.int64()), pa.array(whole),
                ], [c.split()[0] for c in kinds.split(", ")])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with their pieces in order, as documents with one length and one check sum."""
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                crc = 0
                for x in r["pieces"]:
                    crc = crc32_joined(crc, x["ids_crc32"], 4 * x["n_tokens"])
                r["ids_crc32"], r["n_tokens"] = crc, sum(x["n_tokens"] for x in r["pieces"])
            names = [c.split()[0] for c in JOINED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([(r["pieces"][0] | r)[c] for r in rows], pa.int32() if c in ("shard", "block") else pa.int64()) for c in names], names)

    following = blocks.where(F.col("into") > 0).select("shard", (F.col("block") - 1).alias("block"), F.lit(True).alias("open"))
    found = written(blocks.join(following, ["shard", "block"], "left").withColumn("open", F.coalesce("open", F.lit(False))).mapInArrow(decode, kinds), "pieces")
    pieces = F.array_sort(F.collect_list(F.struct("into", "block", "in_block", "doc_id", "n_tokens", "ids_crc32")))
    cut = found.where("not whole").groupBy("shard", "number").agg(pieces.alias("pieces")).select("shard", "pieces").mapInArrow(joined, JOINED)
    docs = found.where("whole").select(*[c.split()[0] for c in JOINED.split(", ")]).unionByName(cut)
    blocks_at = blocks.groupBy("shard", "block").agg(F.sum("n_ids").alias("n"))
    blocks_at = blocks_at.select("shard", "block", _before("n", "shard", "block").alias("in_shard"))
    return (
        docs.join(blocks_at, ["shard", "block"]).join(shards, F.col("shard") == F.col("base_shard"))
        .select("doc_id", (F.col("base") + F.col("in_shard") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32", "shard", "block")
    )


def crc32_joined(a: int, b: int, length: int) -> int:
    """The CRC-32 of two strings one after another, from theirs and the second one's length: shifting a by so many zero bytes is
    a linear map of its bits, put together from those for powers of two."""
    k = 0
    while length:
        if length & 1:
            a = _times(_zeros(k), a)
        k, length = k + 1, length >> 1
    return a ^ b


@lru_cache(maxsize=64)
def _zeros(k: int) -> list[int]:
    """The map of 2 ** k zero bytes, as what becomes of each bit."""
    if k:
        half = _zeros(k - 1)
        return [_times(half, x) for x in half]
    bit = [0xEDB88320] + [1 << j for j in range(31)]
    for _ in range(3):  # two, four and eight zero bits
        bit = [_times(bit, x) for x in bit]
    return bit


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for x in matrix:
        if v & 1:
            out ^= x
        v >>= 1
    return out


def lookup(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, into, ids of some documents (a short list), in pieces by block: only blocks that have them are decoded, and of
    those only their bits. `into` is how many of a document's ids lie before the piece."""
    wanted = set(doc_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hits = [k for k, d in enumerate(r["doc_id"]) if d in wanted]
                ids = [unpack(r["payload"], r["width"], r["at"][k], r["at"][k + 1]).tolist() for k in hits]
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"][k] for k in hits], pa.int64()), pa.array([0 if k else r["into"] for k in hits], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "into", "ids"])

    held = blocks.where(F.arrays_overlap("doc_id", F.array(*[F.lit(int(d)).cast("long") for d in sorted(wanted)])))
    return held.mapInArrow(decode, "doc_id long, into long, ids array<long>")


def _before(value: str, part: str, order: str):
    from pyspark.sql import Window

    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0).cast("long"))
