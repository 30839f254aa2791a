"""A Merkle manifest of a dataset: trees of row digests by group, and proofs that find their siblings by coordinates.

A tree is kept as a table of nodes (grp, level, idx, hash), leaves at level 0. Which siblings a leaf's proof needs follows
from its index and its group's size alone, so a proof is a join of coordinates with the node table. Trees are built and
proofs are found in rounds of a few levels: a round works on blocks of at most BLOCK nodes, and what remains of each
block is a leaf of the next round. A leaf's proof is its own within the block and then the block's, so no node is looked
up by more leaves than a block has, and a group with a third of all rows is as many blocks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import hot_join, written
from larkspur.llm.spans import once

#: Nodes of a block, unless one run has more.
BLOCK = 64
#: The columns that a leaf is made of, and what a group is named by.
FIELDS, GROUP = ["doc_id", "source", "lang", "n_chars", "text"], "lang"


def depth_of(fan_out: int) -> int:
    """Levels of a round."""
    depth = 1
    while fan_out ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


def digest(text: Column) -> Column:
    """The 32 bytes of a text's SHA-256."""
    return F.unhex(F.sha2(text, 256))


def said(hash: Column) -> Column:
    """A digest as the lowercase hexadecimal text that goes into other digests."""
    return F.lower(F.hex(hash))


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each column as its UTF-8 length, a colon and its value, or - for null."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]))


def indexed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves with idx, the place of a row in its grp by `order` (from 0), and n, how many rows the grp has.

    Rows are dealt out by ranges of grp and order and numbered where they are, by group; groups that reach over several
    ranges are summed up in a table of one row for each range and group. Only the first and the last group of a range can
    be in others too, so that what a join needs to know has two rows a range at most. Rows that are equal in all of
    `order` are told apart by that table's own order, which changes no digest.
    """
    names = ["grp", *order]
    carried = [c for c in leaves.columns if c != "grp"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.concatenate([[True], (batch.column(0).slice(1).to_numpy(zero_copy_only=False) != batch.column(0).slice(0, batch.num_rows - 1).to_numpy(zero_copy_only=False))])
            first = np.maximum.accumulate(np.where(code, np.arange(batch.num_rows), 0))
            pos = np.arange(batch.num_rows) - first
            if batch.column(0)[0].as_py() == last:
                pos[first == 0] += seen
            last, seen = batch.column(0)[-1].as_py(), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(pos, pa.int64())], [*batch.schema.names, "part", "pos"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.select("grp", *carried).schema)
    ranged = leaves.repartitionByRange(*names).sortWithinPartitions(*names).select("grp", *carried)
    placed = written(ranged.mapInArrow(number, f"{kinds}, part int, pos long"), "placed")
    counts = written(placed.groupBy("grp", "part").agg(F.count("*").alias("c")), "counts")
    base = F.coalesce(F.sum("c").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = counts.select("grp", "part", base.alias("base")).where("base > 0")
    sizes = written(counts.groupBy("grp").agg(F.sum("c").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).head()[0] or 0
    hot = [r[0] for r in sizes.where(F.col("n") * 1000 >= total).select("grp").collect()]  # a thousand at most
    based = placed.join(F.broadcast(more), ["grp", "part"], "left").select("grp", *carried, (F.col("pos") + F.coalesce("base", F.lit(0))).alias("idx"))
    return written(hot_join(based, sizes, "grp", hot), "indexed")


def _ceil_div(a: Column, k: int) -> Column:
    return F.floor((a + (k - 1)) / F.lit(k)).cast("long") if k & (k - 1) else F.call_function("shiftright", a + (k - 1), F.lit(k.bit_length() - 1))


def _div(a: Column, k: int) -> Column:
    return F.call_function("shiftright", a, F.lit(k.bit_length() - 1)) if k & (k - 1) == 0 else F.floor(a / F.lit(k)).cast("long")


def _levels(nodes: Column, heights: Column, k: int) -> Column:
    """The levels of a block, each an array of digests, from the block's own nodes up to the round's or the group's height."""

    def above(below: Column) -> Column:
        run = lambda i: F.concat(*[F.coalesce(said(F.get(below, i * k + j)), F.lit("")) for j in range(k)])
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(below) + (k - 1)) / k).cast("int") - 1), lambda i: digest(run(i)))

    def up(levels: Column, _) -> Column:
        return F.concat(levels, F.array(above(F.element_at(levels, -1))))

    steps = F.filter(F.sequence(F.lit(1), F.lit(depth_of(k))), lambda x: x <= heights)
    return F.aggregate(steps, F.array(nodes), up)


def _height(n: Column, k: int) -> Column:
    """How many times n nodes are put together, k at once, until one remains."""
    if k == 2:
        return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))
    powers = F.array(*[F.lit(k**j) for j in range(1, 63) if k**j < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n)) + F.when(n > 1, 1).otherwise(0)


def trees(leaves: DataFrame, fan_out: int = 2) -> list[DataFrame]:
    """The rounds of trees over leaves (grp, idx, n, hash): each a table (grp, block, roots, n, levels) of blocks of nodes.

    levels has an array for each level, the block's nodes first; n is how many nodes the group has at the round's
    start. A group's last block has its root. A round has as many times fewer nodes than the one before as a block has nodes.
    """
    wide, rounds, level = fan_out ** depth_of(fan_out), [], leaves.select("grp", "idx", "n", "hash")
    while True:
        blocks = level.groupBy("grp", _div(F.col("idx"), wide).alias("block"), "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("own"))
        blocks = written(blocks.select("grp", "block", "n", _levels(F.col("own"), _height(F.col("n"), fan_out), fan_out).alias("levels")), "blocks")
        rounds.append(blocks)
        level = blocks.where(F.col("n") > wide).select("grp", F.col("block").alias("idx"), _ceil_div(F.col("n"), wide).alias("n"), F.get(F.element_at("levels", -1), F.lit(0)).alias("hash"))
        if level.isEmpty():
            return rounds


def nodes(blocks: DataFrame, fan_out: int = 2) -> DataFrame:
    """The node table of a round: grp, level (within the round), idx (in the group's level), hash."""
    at = blocks.select("grp", "block", F.posexplode("levels").alias("level", "hashes"))
    width = F.pow(F.lit(fan_out), F.lit(depth_of(fan_out)) - F.col("level")).cast("long")
    return at.select("grp", "level", (F.col("block") * width).alias("first"), F.posexplode("hashes").alias("k", "hash")).select("grp", "level", (F.col("first") + F.col("k")).alias("idx"), "hash")


def proofs(leaves: DataFrame, rounds: list[DataFrame], fan_out: int = 2, tops: DataFrame | None = None) -> DataFrame:
    """leaves (grp, idx, n and further columns) with `path`: a struct for each level, (place, others): the leaf's place in its
    run, and the digests of the run's others, left to right.

    Rounds from the top down: leaves explode the coordinates of their siblings, which follow from idx and n, find them in
    the round's node table, and put what they find before the path of their block. tops (grp, path, given): what comes above
    the roots, one row for a group; `given` reaches every leaf of the group.
    """
    depth, found = depth_of(fan_out), None
    wide = fan_out**depth
    power = lambda x: F.pow(F.lit(fan_out), x).cast("long")
    for k in reversed(range(len(rounds))):
        asked = leaves if k == 0 else rounds[k - 1].where(F.col("n") > wide).select("grp", F.col("block").alias("idx"), _ceil_div(F.col("n"), wide).alias("n"))
        height = F.least(F.lit(depth), _height(F.col("n"), fan_out))
        at = asked.select("grp", "idx", "n", F.explode(F.filter(F.sequence(F.lit(0), F.lit(depth - 1)), lambda x: x < height)).alias("level"))
        at = at.withColumn("here", F.floor(F.col("idx") / power(F.col("level"))).cast("long")).withColumn("first", F.col("here") - F.pmod("here", F.lit(fan_out)))
        last = F.least(F.col("first") + (fan_out - 1), F.floor((F.col("n") - 1) / power(F.col("level"))).cast("long"))
        coordinates = at.select("grp", F.col("idx").alias("of"), "level", F.explode(F.filter(F.sequence("first", last), lambda x: x != F.col("here"))).alias("idx"))
        met = coordinates.join(nodes(rounds[k], fan_out), ["grp", "level", "idx"]).groupBy("grp", F.col("of").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("level", F.col("idx").alias("at"), "hash"))).alias("met"))
        own = asked.join(met, ["grp", "idx"], "left").withColumn("block", _div(F.col("idx"), wide))
        at_level = lambda level: F.transform(F.filter(F.coalesce("met", F.array().cast(met.schema["met"].dataType)), lambda x: x["level"] == level), lambda x: x["hash"])
        step = lambda level: F.struct(F.pmod(F.floor(F.col("idx") / power(level)).cast("long"), F.lit(fan_out)).cast("int").alias("place"), at_level(level).alias("others"))
        own = own.withColumn("path", F.transform(F.filter(F.sequence(F.lit(0), F.lit(depth - 1)), lambda x: x < height), step)).drop("met")
        if tops is not None:
            ending = tops.join(rounds[k].where(F.col("n") <= wide).select("grp", "block"), "grp").select("grp", "block", "path", "given")
            found = ending if found is None else found.select("grp", F.col("idx").alias("block"), "path", "given").unionByName(ending)
            above = found.select("grp", "block", F.col("path").alias("above"), "given")
            own = own.join(above, ["grp", "block"]).withColumn("path", F.concat("path", "above")).drop("above")
        elif found is not None:
            above = found.select("grp", F.col("idx").alias("block"), F.col("path").alias("above"))
            own = own.join(above, ["grp", "block"], "left").withColumn("path", F.concat("path", F.coalesce("above", F.array().cast(own.schema["path"].dataType)))).drop("above")
        found = own.drop("block")
        if k:
            found = written(found, "paths")
    return found


def folded(hash: Column, path: Column) -> Column:
    """The digest at the top of a path, from the one at its foot."""

    def step(below: Column, s: Column) -> Column:
        texts = F.transform(s["others"], said)
        return digest(F.concat(F.array_join(F.slice(texts, F.lit(1), s["place"]), ""), said(below), F.array_join(F.slice(texts, s["place"] + 1, F.greatest(F.lit(0), F.size(texts) - s["place"])), "")))

    return F.aggregate(path, hash, step)


def siblings_of(path: Column) -> Column:
    """All digests of a path as one text, from its foot up and left to right."""
    return F.array_join(F.transform(F.flatten(F.transform(path, lambda s: s["others"])), said), "")


def manifest(rows: DataFrame, fields: list[str] = FIELDS, group: str = GROUP, order: str = "doc_id", carried: list[Column] = [], fan_out: int = 2) -> DataFrame:  # noqa: B006
    """order, leaf, subroot, root and path of every row: binary digests and the proof that leads from leaf to root.

    Each value of `group` (null is one of its own and comes first, the others by their UTF-8 bytes) has a tree over its rows
    by `order` (null first; rows that share it by their digests); the trees' roots are the leaves of the tree on top. Runs of
    fan_out nodes have one parent, a shorter last run too; one leaf alone is its tree's root. Texts are hashed where they
    are read and never move. Equal rows are leaves of their own. `carried` are further columns of rows to keep. Other
    columns have no part in it, whatever their names. No rows give no rows.
    """
    cols = [F.col(f"`{c}`") for c in fields]
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    own = rows.select(key.alias("grp"), F.col(f"`{order}`").alias("at"), leaf(cols).alias("hash"), F.struct(F.lit(0), *carried).alias("carried"))
    leaves = indexed(own, ["at", "hash"])
    rounds = trees(leaves, fan_out)
    root_of = lambda rs: reduce(DataFrame.unionByName, [r.where(F.col("n") <= fan_out ** depth_of(fan_out)).select("grp", F.get(F.element_at("levels", -1), F.lit(0)).alias("hash")) for r in rs])
    subroots = written(root_of(rounds).select(F.col("grp").alias("name"), F.lit("").alias("grp"), "hash"), "subroots")
    tops = indexed(subroots, ["name"])
    top_rounds = trees(tops, fan_out)
    root = root_of(top_rounds).head()
    top = proofs(tops, top_rounds, fan_out).select(F.col("name").alias("grp"), "path", F.col("hash").alias("given"))
    whole = proofs(leaves, rounds, fan_out, written(top, "tops"))
    return whole.select(F.col("at").alias(order), F.col("hash").alias("leaf"), F.col("given").alias("subroot"), F.lit(root and bytes(root["hash"])).alias("root"), "path", *[f"carried.`{c}`" for c in own.schema["carried"].dataType.names[1:]])


def checked(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every document's proof, tried on a tampered leaf where
    7 divides the CRC-32 of its doc_id.

    Tampering adds 1 to n_chars and nothing else, so a row without n_chars stays as it was. A null doc_id is never tampered with.
    """
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    as_tampered = leaf([F.col(c) + F.lit(1).cast("long") if c == "n_chars" else F.col(c) for c in FIELDS])
    m = manifest(docs.select(*[F.col(c) for c in FIELDS]), carried=[F.when(tampered, as_tampered).alias("forged")])
    out = m.withColumn("folded", folded(F.coalesce("forged", "leaf"), F.col("path")))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), said(F.col("leaf")).alias("leaf"), said(F.col("subroot")).alias("subroot"), said(F.col("root")).alias("root"),
        F.sha2(siblings_of(F.col("path")), 256).alias("proof_sha256"), said(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
