import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import bestfit, bpe, packbits
from tests.llm.helpers import odd_docs, sample_docs


def library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return tok


def u4(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_packing_returns_what_was_packed(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64)
    raw = packbits.pack(ids, width)
    assert len(raw) == (1001 * width + 7) // 8
    assert packbits.unpack(raw, width, 0, 1001).tolist() == ids.tolist()
    assert packbits.unpack(raw, width, 137, 601).tolist() == ids[137:601].tolist()


@pytest.mark.parametrize("made", [odd_docs, sample_docs])
@pytest.mark.parametrize("block", [1, 1 << 16])
def test_packed_file_against_library(spark, made, block):
    docs = made(spark)
    name = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(tuple(r)[:4] for r in packbits.read_packed(packbits.write_packed(docs, name, 2, block)).collect())
    tok, want, start = library("byte_bpe_50k.json"), [], 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(u4(ids))))
        start += len(ids)
    assert got == want


def test_packed_file_of_nothing(spark):
    docs = sample_docs(spark).limit(0)
    assert packbits.read_packed(packbits.write_packed(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)).collect() == []


@pytest.mark.parametrize(("chunk", "overlap", "slab"), [(1 << 12, 1 << 8, 1 << 18), (100, 30, 300), (20, 12, 20)])
@pytest.mark.parametrize("made", [odd_docs, sample_docs])
def test_chunks_against_library(spark, made, chunk, overlap, slab):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = made(spark).repartition(2)
    got = sorted(map(tuple, bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, chunk, overlap, slab), ranks, public_tokenizers.PATTERN).collect()))
    enc, want = bpe.encoding(ranks, public_tokenizers.PATTERN), []
    for r in docs.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(u4(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_chunks_without_a_common_end(spark):
    texts = ["a" * 500, "ab " * 3 + "x" * 300 + " tail of it", " " * 400 + "z", "12'll" * 90, "é" * 333 + "\n\n\n" * 50]
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = odd_docs(spark, texts)
    got = sorted(map(tuple, bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN, 50, 20, 150), ranks, public_tokenizers.PATTERN).collect()))
    enc = bpe.encoding(ranks, public_tokenizers.PATTERN)
    assert [g[2] for g in got] == [hashlib.sha256(u4(enc.encode_ordinary(t))).hexdigest() for t in texts]


def test_most_of_long_texts_goes_through_stitching(spark):
    import regex

    match = regex.compile(public_tokenizers.PATTERN).finditer
    texts = [r.text or "" for r in sample_docs(spark).collect()]
    pieces = [bpe.stitched(t, match, 1 << 12, 1 << 8) for t in texts]
    assert ["".join(p) for p in pieces] == texts
    long = [(t, p) for t, p in zip(texts, pieces, strict=True) if len(t) > 1 << 12]
    assert sum(len(t) for t, _ in long) > 0.4 * sum(map(len, texts))
    assert sum(len(p) for _, p in long) >= 0.95 * sum(len(t) // (1 << 12) for t, _ in long)


@pytest.mark.parametrize("made", [odd_docs, sample_docs])
def test_pieces_fill_sequences(spark, made):
    docs = made(spark).repartition(3)
    rows = bestfit.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=512, open_bins=8, group=4).collect()
    tok, want = library("word_bpe_49k.json"), []
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k, s, len(ids[s : s + 512]), zlib.crc32(u4(ids[s : s + 512]))) for k, s in enumerate(range(0, len(ids), 512))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 512
    least = -(-sum(r.length for r in rows) // 512)
    assert len(bins) <= least * 1.1 + 3


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = bestfit.BestFit(10, 2)
    assert [fit.put(n) for n in (6, 7, 3, 2)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert fit.put(9) == (2, 0)
    assert fit.put(5) == (3, 0)  # bins 0 (2 free) and 2 (1 free) are open: 2 closes
    assert sorted(fit.left()) == [(0, 8), (3, 5)]


def test_most_pieces_stay_where_the_first_round_puts_them(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(4, "doc_id")
    rows = bestfit.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    again = sum(r["round"] == 2 for r in rows)
    assert 0 < again < 0.15 * len(rows)
    # a task's open bins are 64 at most, so the second round has those of 4 tasks
    assert len({r.sequence_id for r in rows if r["round"] == 2}) <= 4 * 64
    tokens, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert tokens / 2048 > 0.97 * sequences


def test_a_long_text_is_several_blocks_and_is_looked_up_in_them(spark):
    texts = {1: "short", 2: "many words in one text " * 3000, 3: "", 4: "after"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    blocks = packbits.write_packed(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, block_ids=1000)
    sizes = sorted((r.shard, r.block, r.n_ids) for r in blocks.collect())
    assert len(sizes) > 10 and all(n <= 1000 for _, _, n in sizes)
    tok = library("byte_bpe_50k.json")
    want = {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    rows = {r.doc_id: r for r in packbits.read_packed(blocks).collect()}
    at = 0
    for d in sorted(texts):
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(want[d]), zlib.crc32(u4(want[d])))
        at += len(want[d])
    found = {}
    for r in sorted(packbits.lookup(blocks, [2, 3, 9]).collect()):
        assert r["into"] == len(found.setdefault(r.doc_id, []))
        found[r.doc_id] += r.ids
    assert found == {2: want[2], 3: want[3]}


def test_joined_check_sums():
    raw = bytes(range(256)) * 40
    for cut in (0, 1, 77, 5000, len(raw)):
        assert packbits.crc32_joined(zlib.crc32(raw[:cut]), zlib.crc32(raw[cut:]), len(raw) - cut) == zlib.crc32(raw)
