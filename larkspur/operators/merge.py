"""Entities that are one and the same: groups that hang together by names, aliases and likeness, and what becomes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import graph
from larkspur.operators.skew import TASK_ROWS, with_facts
from larkspur.scratch import written

#: Confidences of a canonical name by how it was found; a likeness has its own.
CACHED, BY_ALIAS, ITSELF = 1.0, 0.95, 0.5


def components(links: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, root) for every node of links (a, b): the least node that can be reached from it.

    Stars in turn: every node's larger neighbours are linked to its least neighbour, then its smaller ones are, until all
    links lead to roots. Only least neighbours are gathered, never lists; a node that very many links have meets its least
    neighbour in a broadcast; the links never grow in number, and each step is written, so that a lost executor costs one step.
    Nulls are no nodes, and links of a node with itself give that node.
    """
    named = links.where("a is not null and b is not null")
    e = written(named.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    alone = e.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("root"))
    e, before = e.where("u <> v"), None
    while True:
        both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_facts(both.where("v > u"), least, ["u"], task_rows=task_rows).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_facts(large, parent, ["u"], task_rows=task_rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.unionByName(parent.select("u", F.col("m").alias("v"))).distinct(), "small")
        state = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head())
        if state == before:
            break
        before = state
    hung = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = hung.select(F.col("root").alias("node"), "root").distinct()
    own = hung.unionByName(tops)
    return own.unionByName(alone.join(own.select("node"), "node", "left_anti"))


def duplicate_links(entities: DataFrame, least: float | None = None) -> DataFrame:
    """(a, b) of entities (entity_id, name, aliases) that share a name or an alias in any case, one's alias being another's name
    too; with `least`, also of those whose names have that Levenshtein ratio: each name with the one nearest to it.

    All that share a term are linked to the least of them, so a term that very many share makes a link for each and no pairs.
    """
    named = F.array_union(F.array(F.lower("name")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(x)))
    terms = written(entities.where("entity_id is not null").select("entity_id", F.lower("name").alias("name"), F.explode(F.array_compact(named)).alias("term")), "terms")
    first = terms.groupBy("term").agg(F.min("entity_id").alias("b"))
    shared = with_facts(terms.select("term", "entity_id"), first, ["term"]).select(F.col("entity_id").alias("a"), "b")
    if least is None:
        return shared
    names = terms.where("name = term").groupBy("name").agg(F.min("entity_id").alias("entity_id"))
    near = graph.best_match(names.select("name"), names.select("name"), least, others=True)
    a = near.join(names, "name").select("match", F.col("entity_id").alias("a"))
    return shared.unionByName(a.join(names.select(F.col("name").alias("match"), F.col("entity_id").alias("b")), "match").select("a", "b"))


def groups(entities: DataFrame, least: float | None = None) -> DataFrame:
    """entity_id, group_id: entities that hang together over any number of duplicate_links(), by the least entity_id."""
    return components(duplicate_links(entities, least)).select(F.col("node").alias("entity_id"), F.col("root").alias("group_id"))


def merged(entities: DataFrame, group_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What groups (entity_id, group_id) make of entities (entity_id, name, aliases, mentions): a row for each group (group_id,
    canonical, members, mentions), and its other names (group_id, alias), each once in whatever case came first in order.

    The canonical name is the one most mentioned, of equally mentioned ones the greatest; null where no member has a name. Aliases are rows, as a group may have any
    number of them.
    """
    d = written(entities.join(group_of, "entity_id"), "grouped")
    one = d.groupBy("group_id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.struct("mentions", "name"))).alias("canonical"), F.count("*").alias("members"), F.sum("mentions").alias("mentions"))
    one = written(one, "canonical")
    said = d.select("group_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("alias is not null")
    named = said.groupBy("group_id", F.lower("alias").alias("low")).agg(F.min("alias").alias("alias"))
    other = with_facts(written(named, "aliases"), one.select("group_id", "canonical"), ["group_id"])
    return one, other.where(~F.col("low").eqNullSafe(F.lower("canonical"))).select("group_id", "alias")


def merged_relations(edges: DataFrame, group_of: DataFrame) -> DataFrame:
    """src, dst, type, confidence, mentions, merged: edges between entities with both ends replaced by their groups.

    Edges that come to join a group with itself go; those that come to be the same are one, with the greatest confidence,
    all mentions and how many they were. Ends that are in no group stay as they are.
    """
    e = written(edges, "edges")
    for end in ("src", "dst"):
        to = group_of.select(F.col("entity_id").alias(end), F.col("group_id").alias("to"))
        e = written(with_facts(e, to, [end], "left").withColumn(end, F.coalesce("to", end)).drop("to"), "edges")
    return e.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"), F.count("*").alias("merged"))


def canonicalised(names: DataFrame, known: DataFrame, cache: DataFrame | None = None, aliases: DataFrame | None = None, least: float = 0.8) -> DataFrame:
    """name, canonical, method, confidence of each different name, by the first of these that has it, in any case and without
    white space at its ends: `cache` (name, canonical) of earlier answers, `aliases` (name, canonical), the `known` name (name)
    that is nearest by Levenshtein ratio, from `least` on; else the name is its own. Only names that the earlier steps leave go on
    to the later ones. Null names have no row.
    """
    low = lambda c: F.lower(F.trim(c))
    todo = names.where("name is not null").select("name").distinct().withColumn("key", low(F.col("name")))
    empty = names.sparkSession.createDataFrame([], "name string, canonical string")
    out = []
    for method, confidence, table in (("cache", CACHED, cache), ("alias", BY_ALIAS, aliases)):
        table = empty if table is None else table
        one = table.where("name is not null").groupBy(low(F.col("name")).alias("key")).agg(F.min("canonical").alias("canonical"))
        met = written(todo.join(one, "key", "left"), method)
        out.append(met.where("canonical is not null").select("name", "canonical", F.lit(method).alias("method"), F.lit(confidence).alias("confidence")))
        todo = met.where("canonical is null").select("name", "key")
    keyed = known.where("name is not null").groupBy(low(F.col("name")).alias("match")).agg(F.min("name").alias("canonical"))
    near = graph.best_match(todo.select(F.col("key").alias("name")), keyed.select(F.col("match").alias("name")), least)
    near = near.join(keyed, "match").select(F.col("name").alias("key"), "canonical", "ratio")
    rest = todo.join(near, "key", "left")
    found = F.col("canonical").isNotNull()
    out.append(rest.select("name", F.coalesce("canonical", "name").alias("canonical"), F.when(found, "fuzzy").otherwise("self").alias("method"), F.when(found, F.col("ratio")).otherwise(ITSELF).alias("confidence")))
    return out[0].unionByName(out[1]).unionByName(out[2])
