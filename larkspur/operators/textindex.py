"""A stored text index for BM25: postings by term and range of documents, in segments that are added, merged and cleared.

An index is a folder. Each call of add() puts one segment there, a folder of its own with three tables:

* `docs` (ord, id, length): documents in order of id; ord numbers them, so a range of SPAN numbers is a block.
* `postings` (bucket, term, range, n, offsets, tfs, lengths, most, least): a row for a term in a block: the n documents that
  have it, as two-byte deltas from the block's first number, how often each has it, and how long each is. `most` and
  `least` are the greatest frequency and the least length: together they bound every score in the block, whatever the mean
  length of all documents has become. `bucket`, a hash of the term, is a partition column; rows lie in order of term.
* `gone` (segment, range, ords): documents of earlier segments that the segment replaces or deletes.

A search reads the buckets of its terms only, and of them the terms' row groups. Blocks whose bounds, added up over the terms,
stay below the k-th best score of the most promising blocks are never opened.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators.retrieval import K1, B
from larkspur.scratch import remove

#: Documents of a block (a power of two), buckets of terms, promising ranges that are opened first, and what a batch may ask.
SPAN_BITS, BUCKETS, PROMISING, MOST_TERMS, MOST_ASKED = 10, 64, 8, 4096, 65_536

POSTINGS = "term string, range long, n int, offsets array<short>, tfs array<int>, lengths array<int>, most int, least int, bucket int"
GONE = "of string, range long, ords array<long>"

#: Bytes of texts that a task numbers and cuts, postings of documents that a task sorts or adds up, and words that a block holds at most, if
#: it has more than one document. None depends on the size of the index: a larger one is more tasks.
TASK_BYTES, TASK_HITS, BLOCK_WORDS = 1 << 24, 1 << 20, 1 << 21
#: Rows that may share an id before they are reduced to one where they are.
OF_ONE_ID = 1000


def bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def _whole(spark: SparkSession, path: str) -> list[str]:
    """The folders of all segments whose mark, which is written last, is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segment=*/whole/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(x.getPath().getParent().getParent().toString() for x in found) if found else []


def _name(folder: str) -> str:
    return folder.rsplit("/", 1)[1]


def segments(spark: SparkSession, path: str) -> list[str]:
    """The folders of an index's segments, the oldest first, without those that others have replaced."""
    whole = _whole(spark, path)
    replaced = {r[0] for r in spark.read.schema("name string").json([f"{p}/whole" for p in whole]).collect()} if whole else set()
    return [p for p in whole if _name(p) not in replaced]


def _new_segment(spark: SparkSession, path: str) -> str:
    last = max((int(_name(p).removeprefix("segment=").split("-")[0]) for p in _whole(spark, path)), default=0)
    return f"{path}/segment={last + 1:06d}-{uuid.uuid4().hex[:8]}"


def _mark(spark: SparkSession, folder: str, replaces: list[str]) -> None:
    """What makes a segment whole, and at the same moment what it replaces no longer a part of the index."""
    spark.createDataFrame([(_name(p),) for p in replaces], "name string").coalesce(1).write.json(f"{folder}/whole")


def _write_postings(rows: DataFrame, folder: str, hits: int, merge: bool = False) -> None:
    """rows (term, range, n, offsets, tfs, lengths, most, least) as a segment's postings; with `merge`, several rows of a term and
    range, of different documents, become one. hits: how many documents all rows have.

    A task has the rows of a few cells, each a part of one bucket. A term lies in more than one cell if it has very many blocks.
    """
    tasks = 1 + hits // (4 * TASK_HITS)
    cell = F.pmod(F.hash("term", F.shiftright("range", 6)), F.lit(-(-4 * tasks // BUCKETS)))
    rows = rows.withColumns({"bucket": bucket(F.col("term")), "cell": cell}).repartition(tasks, "bucket", "cell")
    if merge:
        one = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("offsets", "tfs", "lengths"))))
        g = rows.groupBy("bucket", "cell", "term", "range").agg(one.alias("x"), F.max("most").alias("most"), F.min("least").alias("least"))
        rows = g.select("*", F.size("x").alias("n"), F.col("x.offsets").alias("offsets"), F.col("x.tfs").alias("tfs"), F.col("x.lengths").alias("lengths"))
    rows = rows.select("term", "range", "n", "offsets", "tfs", "lengths", "most", "least", "bucket")
    rows.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{folder}/postings")


def _listed(values: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """values as lists that begin at begins."""
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)), pa.int32()), pa.array(values, kind))


def _runs(term: Callable, row: np.ndarray, rng: np.ndarray, offset: np.ndarray, tf: np.ndarray, length: np.ndarray) -> dict[str, pa.Array]:
    """Postings of documents in order of row and range, as a posting for each row and range. term: the terms of rows."""
    new = np.append(True, (row[1:] != row[:-1]) | (rng[1:] != rng[:-1])) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    most, least = (np.maximum.reduceat(tf, at), np.minimum.reduceat(length, at)) if len(at) else (tf, length)
    return {
        "term": term(pa.array(row[at])), "range": pa.array(rng[at], pa.int64()), "n": pa.array(np.diff(np.append(at, len(row))), pa.int32()),
        "offsets": _listed(offset, at, pa.int16()), "tfs": _listed(tf, at, pa.int32()), "lengths": _listed(length, at, pa.int32()),
        "most": pa.array(most, pa.int32()), "least": pa.array(least, pa.int32()),
    }


def _cut(batches: Iterator[pa.RecordBatch], span_bits: int, block_words: int) -> Iterator[pa.RecordBatch]:
    """Documents (ord, id, w) of a task, in order, as rows of both kinds: numbered documents (ord, id, length), and the postings
    of each block. A block ends with its SPAN documents, or before more than block_words words; numbers go on with the next block."""
    span, start, docs, words, held = 1 << span_bits, None, 0, 0, []

    def row_batch(schema: pa.Schema, found: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(next(iter(found.values())))
        return pa.RecordBatch.from_arrays([found[f.name] if f.name in found else pa.nulls(n, f.type) for f in schema], schema=schema)

    def block(schema: pa.Schema) -> pa.RecordBatch:
        said = pa.chunked_array([x for x, _ in held], pa.string()).combine_chunks().dictionary_encode()
        said = said.combine_chunks() if isinstance(said, pa.ChunkedArray) else said
        length = np.concatenate([x for _, x in held]).astype(np.int64)
        code = said.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key, tf = np.unique((code << span_bits) | np.repeat(np.arange(len(length)), length), return_counts=True)
        doc = key & (span - 1)
        return row_batch(schema, _runs(said.dictionary.take, key >> span_bits, np.full(len(key), start >> span_bits), doc, tf, length[doc]))

    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if schema is None:
            start, ints = batch.column(0)[0].as_py(), pa.list_(pa.int32())
            schema = pa.schema([("ord", pa.int64()), ("id", batch.column(1).type), ("length", pa.int32()), ("term", pa.string()), ("range", pa.int64()), ("n", pa.int32()), ("offsets", pa.list_(pa.int16())), ("tfs", ints), ("lengths", ints), ("most", pa.int32()), ("least", pa.int32())])
        size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(size):
            fit = int(np.searchsorted(np.cumsum(size[at : at + span - docs], dtype=np.int64), block_words - words, "right"))
            if fit or not docs:
                fit = max(fit, 1)
                own = size[at : at + fit]
                held.append((batch.column(2).slice(at, fit).flatten().cast(pa.string()), own))
                yield row_batch(schema, {"ord": pa.array(np.arange(start + docs, start + docs + fit), pa.int64()), "id": batch.column(1).slice(at, fit), "length": pa.array(own, pa.int32())})
                at, docs, words = at + fit, docs + fit, words + int(own.sum())
            if docs == span or words >= block_words or at < len(size):
                yield block(schema)
                start, docs, words, held = start + span, 0, 0, []
    if docs:
        yield block(schema)


def _moved(blocks: pa.Table, numbers: pa.Table, span_bits: int) -> pa.Table:
    """Postings (term, offsets, tfs, lengths) of one block, as those of the blocks in which its documents (old, ord) are now."""
    span, to = 1 << span_bits, np.full(1 << span_bits, -1)
    to[numbers["old"].to_numpy() & (span - 1)] = numbers["ord"].to_numpy()
    flat = lambda c: blocks[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    new = to[flat("offsets")]
    row = np.repeat(np.arange(blocks.num_rows), pc.list_value_length(blocks["offsets"]).to_numpy())
    stay = new >= 0
    row, new, tf, length = row[stay], new[stay], flat("tfs")[stay], flat("lengths")[stay]
    return pa.table(_runs(blocks["term"].combine_chunks().take, row, new >> span_bits, new & (span - 1), tf, length))


def _docs(spark: SparkSession, parts: list[str], schema: str) -> DataFrame:
    """All segments' documents with `of`, their segment's folder name."""
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{p}/docs").withColumn("of", F.lit(_name(p))) for p in parts])


def _gone(spark: SparkSession, parts: list[str]) -> DataFrame:
    """of, range, ords (sorted) of documents that are not there any more; a segment's later replacements add to the earlier ones."""
    every = reduce(DataFrame.unionByName, [spark.read.schema(GONE).parquet(f"{p}/gone") for p in parts])
    return every.groupBy("of", "range").agg(F.array_distinct(F.flatten(F.collect_list("ords"))).alias("ords"))


def _bits(ords: Column) -> Column:
    """Numbers of a range as bits, 64 to a long, so that whether one is there takes one look."""
    offset = lambda o: o.bitwiseAND(F.lit((1 << SPAN_BITS) - 1)).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)))
    longs = F.sequence(F.lit(0), F.lit(((1 << SPAN_BITS) - 1) >> 6))
    return F.transform(longs, lambda k: F.aggregate(F.filter(F.transform(ords, offset), lambda x: F.shiftright(x, 6) == k), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit(x))))


def _here(offset: Column) -> Column:
    """Whether the document at an offset of a range has not gone, as the range's `bits` tell."""
    o = offset.cast("int")
    return F.call_function("shiftright", F.get("bits", F.shiftright(o, 6)), o.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 0


def _bury(live: DataFrame, ids: DataFrame, folder: str) -> None:
    """Writes which documents (of, ord, id) go as ids come again or are deleted."""
    dead = live.join(ids, "id", "left_semi").groupBy("of", F.shiftright("ord", SPAN_BITS).alias("range")).agg(F.collect_list("ord").alias("ords"))
    dead.select("of", "range", "ords").write.parquet(f"{folder}/gone")


def add(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", words: Callable[[Column], Column] = T.ascii_words) -> str:
    """Puts documents into the index at path, as one new segment, and takes out those of the same ids that were there.

    Texts are cut into words once. Null texts, and texts without words, are documents that no search finds and that count
    for nothing; null ids are left out; of rows that share an id the one with the greatest text stays. Returns the
    segment's folder.
    """
    spark = docs.sparkSession
    folder, parts = _new_segment(spark, path), segments(spark, path)
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    if d.groupBy("id").count().where(F.col("count") > OF_ONE_ID).limit(1).count():
        d = d.groupBy("id").agg(F.max("text").alias("text"))  # where they are, before one task has all of an id
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    # in order of id, so that a lesser number is a lesser id; what shares an id is in one range
    ordered = d.repartitionByRange(1 + size // TASK_BYTES, "id").groupBy("id").agg(F.max("text").alias("text")).sortWithinPartitions("id")
    listed = ordered.select(F.monotonically_increasing_id().alias("ord"), "id", words(F.coalesce("text", F.lit(""))).alias("w"))
    span_bits, block_words = SPAN_BITS, BLOCK_WORDS
    schema = f"ord long, id {kind}, length int, {POSTINGS.removesuffix(', bucket int')}"
    listed.mapInArrow(lambda batches: _cut(batches, span_bits, block_words), schema).write.parquet(f"{folder}/cut")
    cut = spark.read.schema(schema).parquet(f"{folder}/cut")
    cut.where("ord is not null").select("ord", "id", "length").write.parquet(f"{folder}/docs")
    rows = cut.where("term is not null").drop("ord", "id", "length")
    _write_postings(rows, folder, rows.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0])
    if parts:
        _bury(_docs(spark, parts, f"ord long, id {kind}"), cut.where("ord is not null").select("id"), folder)
    else:
        spark.createDataFrame([], GONE).write.parquet(f"{folder}/gone")
    remove(spark, f"{folder}/cut")
    _mark(spark, folder, [])
    return folder


def delete(ids: DataFrame, path: str) -> None:
    """Takes documents out of the index by id (the first column of ids): a segment without documents of its own."""
    spark = ids.sparkSession
    parts = segments(spark, path)
    if not parts:
        return
    folder, kind = _new_segment(spark, path), ids.schema[0].dataType.simpleString()
    spark.createDataFrame([], f"ord long, id {kind}, length int").write.parquet(f"{folder}/docs")
    _write_postings(spark.createDataFrame([], POSTINGS).drop("bucket"), folder, 0)
    _bury(_docs(spark, parts, f"ord long, id {kind}"), ids.toDF("id").distinct(), folder)
    _mark(spark, folder, [])


def optimise(spark: SparkSession, path: str, id_type: str = "bigint") -> str | None:
    """Merges all segments into one without what has gone; a reader of the old ones may finish, they stay until vacuum().

    Postings are merged, no text is read: documents get new numbers in order of id, and postings follow them, a block at a time: its
    documents come to lie in one or more new blocks, and what comes to lie in the same one is put together.
    """
    parts = segments(spark, path)
    if not parts:
        return None
    folder, schema = _new_segment(spark, path), f"ord long, id {id_type}, length int"
    full = [p for p in parts if spark.read.schema(schema).parquet(f"{p}/docs").limit(1).count()]
    if len(full) == 1 and not _gone(spark, parts).where(F.col("of") == _name(full[0])).limit(1).count():
        _copied(spark, full[0], folder, schema)  # nothing to be merged
        _mark(spark, folder, parts)
        return folder
    stored = _live_docs(spark, parts, schema)
    stored.repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("ord"), "id", "length", "of", F.col("ord").alias("old")).write.parquet(f"{folder}/renumbered")
    renumbered = spark.read.schema(f"ord long, id {id_type}, length int, of string, old long").parquet(f"{folder}/renumbered")
    renumbered.select("ord", "id", "length").write.parquet(f"{folder}/docs")
    blocks = _blocks(spark, parts).select("of", "range", "term", "n", "offsets", "tfs", "lengths")
    hits, keys, span_bits = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0], ["of", "range"], SPAN_BITS
    numbers = renumbered.select("of", F.shiftright("old", SPAN_BITS).alias("range"), "old", "ord")
    blocks = blocks.join(F.broadcast(numbers.select(*keys).distinct()), keys, "left_semi")  # a row for each block: those with documents that stay
    both = blocks.repartition(1 + hits // (4 * TASK_HITS), *keys).groupBy(*keys).cogroup(numbers.groupBy(*keys))
    moved = both.applyInArrow(lambda b, x: _moved(b, x, span_bits), POSTINGS.removesuffix(", bucket int"))
    _write_postings(moved, folder, hits, merge=True)
    remove(spark, f"{folder}/renumbered")
    spark.createDataFrame([], GONE).write.parquet(f"{folder}/gone")
    _mark(spark, folder, parts)
    return folder


def _copied(spark: SparkSession, segment: str, folder: str, schema: str) -> None:
    """Writes the documents and postings of a segment again, file by file."""
    spark.read.schema(schema).parquet(f"{segment}/docs").write.parquet(f"{folder}/docs")
    postings = spark.read.schema(POSTINGS).option("basePath", f"{segment}/postings").parquet(f"{segment}/postings")
    postings.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{folder}/postings")
    spark.createDataFrame([], GONE).write.parquet(f"{folder}/gone")


def clear(spark: SparkSession, path: str, id_type: str = "bigint") -> None:
    """An index without documents: one empty segment in place of all others."""
    parts, folder = segments(spark, path), _new_segment(spark, path)
    spark.createDataFrame([], f"ord long, id {id_type}, length int").write.parquet(f"{folder}/docs")
    _write_postings(spark.createDataFrame([], POSTINGS).drop("bucket"), folder, 0)
    spark.createDataFrame([], GONE).write.parquet(f"{folder}/gone")
    _mark(spark, folder, parts)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the folders of segments that have been replaced, and says how many they were. No search of them may be running."""
    stay = segments(spark, path)
    old = [p for p in _whole(spark, path) if p not in stay]
    for p in old:
        remove(spark, p)
    return len(old)


def _live_docs(spark: SparkSession, parts: list[str], schema: str) -> DataFrame:
    dead = _gone(spark, parts).select("of", F.explode("ords").alias("ord"))
    return _docs(spark, parts, schema).join(dead, ["of", "ord"], "left_anti")


def _blocks(spark: SparkSession, parts: list[str], terms: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Postings of all segments (of some terms only, which lie in those buckets), with `bits`, what of the range has gone."""

    def of(p: str) -> DataFrame:
        d = spark.read.schema(POSTINGS).option("basePath", f"{p}/postings").parquet(f"{p}/postings")
        d = d if terms is None else d.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return d.withColumn("of", F.lit(_name(p)))

    every = reduce(DataFrame.unionByName, map(of, parts))
    if len(parts) == 1:
        return every.withColumn("bits", F.lit(None).cast("array<long>"))
    return every.join(_gone(spark, parts).select("of", "range", _bits(F.col("ords")).alias("bits")), ["of", "range"], "left")


def opened(blocks: DataFrame, *carried: str) -> DataFrame:
    """A row for each document of blocks that has not gone: of, term, number, tf, length, and carried columns."""
    all_of = F.arrays_zip("offsets", F.col("tfs").alias("tf"), F.col("lengths").alias("length"))
    there = F.when(F.col("bits").isNull(), all_of).otherwise(F.filter(all_of, lambda x: _here(x["offsets"])))
    rows = blocks.select("of", "term", "range", *carried, F.explode(there).alias("x"))
    return rows.select("of", "term", *carried, (F.shiftleft("range", SPAN_BITS) + F.col("x.offsets")).alias("number"), "x.tf", "x.length")


def parsed(queries: DataFrame) -> DataFrame:
    """query_id, terms, every: from (query_id, match), expressions of quoted terms with AND or OR, as text.fts_query makes them.

    `every`: whether a document must have all terms, which it must unless OR stands between them. Terms are lower-cased, each
    once; a null expression, or one without a quoted term, has no terms and finds nothing.
    """
    found = F.regexp_extract_all(F.lower("match"), F.lit('"([^"]+)"'), F.lit(1))
    return queries.select("query_id", F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))).alias("terms"), (~F.coalesce(F.col("match").rlike(r'"\s+OR\s+"'), F.lit(False))).alias("every"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, id_type: str = "bigint") -> DataFrame:
    """query_id, id, score: for each query (query_id, terms, every) the k documents that score best by BM25, ties to lesser ids.

    The queries are a batch: what they ask goes to every task, MOST_ASKED words of MOST_TERMS different ones at most, and
    the terms choose buckets and row groups. Then the blocks of a query are told by their range: the bounds of a range's
    terms, added up, bound every score in it. The PROMISING ranges with the greatest bounds are opened first; what the k-th
    best document in them scores is what a range must be able to reach to be opened at all. A query whose promising
    ranges have fewer than k documents opens all its ranges, so the result is that of a scan of all documents.
    """
    parts = segments(spark, path)
    rows = queries.select("query_id", "every", F.size("terms").alias("wanted"), F.explode("terms").alias("term")).select("*", bucket(F.col("term")).alias("b")).limit(MOST_ASKED + 1).collect()
    terms, buckets = sorted({r["term"] for r in rows}), sorted({r["b"] for r in rows})
    if len(rows) > MOST_ASKED or len(terms) > MOST_TERMS:
        raise ValueError(f"a batch of more than {MOST_ASKED} words or {MOST_TERMS} different ones")
    query_type = queries.schema["query_id"].dataType.simpleString()
    if not parts or not rows:
        return spark.createDataFrame([], f"query_id {query_type}, id {id_type}, score double")
    blocks = _blocks(spark, parts, terms, buckets)
    n, mean = (_live_docs if len(parts) > 1 else _docs)(spark, parts, "ord long, length int").where("length > 0").agg(F.count("*"), F.avg("length")).head()
    there = F.filter("offsets", _here)
    df = dict(blocks.groupBy("term").agg(F.sum(F.when(F.col("bits").isNull(), F.col("n")).otherwise(F.size(there)))).collect())  # a row for each term
    idf = {t: math.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items() if c}
    asked = F.broadcast(spark.createDataFrame([(r["query_id"], r["every"], r["wanted"], r["term"], idf[r["term"]]) for r in rows if r["term"] in idf], f"query_id {query_type}, every boolean, wanted int, term string, idf double"))
    weight = lambda tf, length: F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean or 1.0)))

    keys = ["query_id", "of", "range"]

    def scored(wanted: DataFrame) -> DataFrame:
        """Of blocks that are dealt out by keys: a document's terms are in one task, so only the best documents are shuffled."""
        d = opened(wanted, *keys[::2], "every", "wanted", "idf").groupBy(*keys, "number", "every", "wanted").agg(F.sum(weight(F.col("tf"), F.col("length"))).alias("score"), F.count("*").alias("met"))
        return d.where(~F.col("every") | (F.col("met") == F.col("wanted"))).select("query_id", "of", "number", F.round("score", 6).alias("score"))

    dealt = lambda d, hits: d.repartition(1 + hits // TASK_HITS, *keys)
    found = blocks.join(asked, "term")
    hits = found.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    if n > PROMISING << SPAN_BITS:
        bound = found.groupBy(*keys, "every", "wanted").agg(F.sum(weight(F.col("most"), F.col("least"))).alias("bound"), F.count("*").alias("terms"))
        bound = bound.where(~F.col("every") | (F.col("terms") == F.col("wanted"))).select(*keys, "bound")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "of", "range"))
        promising = bound.withColumn("place", place).where(F.col("place") <= PROMISING).select(*keys)
        first = scored(dealt(found.join(F.broadcast(promising), keys), min(hits, len(rows) * PROMISING << SPAN_BITS)))  # PROMISING rows for each query
        kth = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", F.col("score").alias("least_score"))
        reach = bound.join(F.broadcast(kth), "query_id", "left").where(F.col("least_score").isNull() | (F.col("bound") >= F.col("least_score") - 1e-6))  # a row for each query
        found = dealt(found, hits).join(reach.select(*keys), keys)
    else:
        found = dealt(found, hits)
    best = scored(found).withColumn("place", F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.desc("score"), "number"))).where(F.col("place") <= k)
    named = best.drop("place").join(_docs(spark, parts, f"ord long, id {id_type}").withColumnRenamed("ord", "number"), ["of", "number"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return named.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "id", "score")


def terms_of(spark: SparkSession, path: str) -> DataFrame:
    """term, documents, occurrences of all that an index holds."""
    return opened(_blocks(spark, segments(spark, path))).groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))
