"""Entities and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.skew import with_facts
from larkspur.scratch import written


def khop(edges: DataFrame, seeds: DataFrame, depth: int, least: float = 0.0) -> DataFrame:
    """(seed, node, hops, confidence): nodes within `depth` edges of each seed, at their fewest hops, best confidence.

    One frame has all that is found. In a hop the nodes found last meet their edges, each row stays beside its neighbours,
    and one aggregation keeps a node of a seed once: its fewest hops and their best confidence. So a hop is one scan of the
    edges, one join and one aggregation, and cycles add nothing.
    """
    e = edges.where(F.col("confidence") >= least).select("src", "dst", "confidence")
    found = seeds.select(F.col("node").alias("seed"), "node").distinct().select("*", F.struct(F.lit(0).alias("hops"), F.lit(-1.0).alias("c")).alias("best"))
    for hop in range(1, depth + 1):
        near = found.join(e, (F.col("node") == F.col("src")) & (F.col("best.hops") == hop - 1), "left")
        far = F.struct(F.col("dst").alias("node"), F.struct(F.lit(hop).alias("hops"), (F.col("best.c") * F.col("confidence")).alias("c")).alias("best"))
        both = F.filter(F.array(F.struct("node", "best"), far), lambda x: x["node"].isNotNull())
        found = near.select("seed", F.explode(both).alias("x")).groupBy("seed", F.col("x.node").alias("node")).agg(F.min("x.best").alias("best"))
    return found.where("best.hops > 0").select("seed", "node", F.col("best.hops").alias("hops"), (-F.col("best.c")).alias("confidence"))


def same_pairs(d: DataFrame, key: str, by: list[str], block: int = 256, task_pairs: int = 1 << 23, task_meetings: int = 1 << 12) -> DataFrame:
    """(a, b): all pairs of rows that agree in `by`, by their keys, a < b; nulls agree with nothing, repeated keys count as rows.

    A group's keys are cut, by their hashes, into blocks, as many as it needs, and each block meets itself and the later ones:
    it is sent to each of its meetings, from tasks that send task_meetings of them on the whole, and two blocks meet where
    both arrive. Meetings are dealt out to tasks by the number of pairs, so a large group is many tasks; a first pass counts
    the pairs. No step has a whole group in one task if it is large: groups are counted as they are, and a row learns how many
    blocks its group has where it is. No pair is made twice but within a block. Blocks are short as Spark holds what one
    meeting makes in memory.
    """
    g = [f"g{i}" for i in range(len(by))]
    d = d.select(*(F.col(c).alias(n) for c, n in zip(by, g, strict=True)), F.col(key).alias("key"))
    d = reduce(lambda x, c: x.where(F.col(c).isNotNull()), d.columns, d)
    counts = written(d.groupBy(*g).count(), "counts")
    n = F.col("count").cast("double")
    of = F.ceil(n / block)
    pairs, meetings = (x or 0 for x in counts.where("count > 1").agg(F.sum(n * (n - 1) / 2), F.sum(of.cast("double") * (of + 1) / 2)).head())
    placed = with_facts(d, counts.where("count > 1"), g, counts=counts).select(*g, of.cast("int").alias("of"), F.pmod(F.xxhash64("key"), of).cast("int").alias("i"), "key")
    blocks = placed.repartition(1 + int(meetings / task_meetings), *g, "i").groupBy(*g, "of", "i").agg(F.sort_array(F.collect_list("key")).alias("x"))
    deal = lambda d: d.repartition(min(1 + int(pairs / task_pairs), 50_000), *g, "i", "j")
    first = blocks.select(*g, "i", F.explode(F.sequence("i", F.col("of") - 1)).alias("j"), "x")
    later = blocks.select(*g, F.explode(F.sequence(F.lit(0), "i")).alias("i"), F.col("i").alias("j"), F.col("x").alias("y"))
    meet = deal(first).join(deal(later).hint("merge"), [*g, "i", "j"])
    met = meet.select("i", "j", "y", F.explode("x").alias("a")).select("i", "j", "a", F.explode("y").alias("b"))
    return met.where("i < j or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def merged_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both by (src, dst, type): greatest confidence, first fact there is (old before new), mentions added up."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    fact = F.min(F.when(F.col("fact").isNotNull(), F.struct("age", "fact")))["fact"]
    return both.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), fact.alias("fact"), F.sum("mentions").alias("mentions"))


def merged_vertices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (name, type, aliases, confidence, mentions, seen) of both, one for each name in lower case.

    As when new ones are merged into old ones: the name and type that were there first stay, confidence is the greatest, aliases
    are a set of all in lower case without the name, mentions add up, and `seen` is the last time. Aliases are gathered by
    entity: those that one has, which are few.
    """
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1))).where("name is not null").withColumn("key", F.lower("name"))
    known = F.min(F.when(F.col("type").isNotNull(), F.struct("age", "type")))["type"]
    aliases = F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: F.lower(x)))))
    g = both.groupBy("key").agg(F.min(F.struct("age", "name"))["name"].alias("name"), known.alias("type"), aliases.alias("aliases"), F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"), F.max("seen").alias("seen"))
    return g.withColumn("aliases", F.sort_array(F.filter("aliases", lambda x: x.isNotNull() & (x != F.col("key"))))).drop("key")


def repointed(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their canonical names (alias, name); loops and repeats go."""
    e = edges
    for end in ("src", "dst"):
        m = canonical.select(F.col("alias").alias(end), F.col("name").alias("to"))
        e = e.join(m, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return e.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def combined_aliases(entities: DataFrame) -> DataFrame:
    """One entity for each name in lower case: canonical (the most mentioned, then first), other names and aliases, mentions."""
    g = entities.groupBy(F.lower("name").alias("key")).agg(F.max_by("name", F.struct("mentions", "name")).alias("canonical"), F.flatten(F.collect_list(F.array_union("aliases", F.array("name")))).alias("every"), F.sum("mentions").alias("mentions"))
    return g.select("key", "canonical", F.sort_array(F.array_except(F.array_distinct("every"), F.array("canonical"))).alias("aliases"), "mentions")


def orphans(links: DataFrame, memories: DataFrame, episodes: DataFrame) -> DataFrame:
    """Links (memory_id, episode_id) with a missing end: which."""
    no_memory = links.join(memories, "memory_id", "left_anti").select("memory_id", "episode_id", F.lit("memory").alias("missing"))
    no_episode = links.join(episodes, "episode_id", "left_anti").select("memory_id", "episode_id", F.lit("episode").alias("missing"))
    return no_memory.unionByName(no_episode)


# Pairs of edge types that make a hint.
HINTS = {("ENJOYS", "IS_A"): "enjoys_category", ("WORKS_ON", "USES"): "works_with_technology", ("KNOWS", "RELATED_TO"): "knows_related"}


def hints(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """start, end, pattern, confidence of pairs of edges one after another whose types make a hint; the best of each.

    tasks: how many tasks edges, and then hints, are dealt out to before they are told apart; as the session has it if not given.
    """
    deal = lambda d, *by: d.repartition(tasks, *by) if tasks else d
    a = edges.select(F.col("src").alias("start"), F.col("dst").alias("mid"), F.col("type").alias("t1"), F.col("confidence").alias("c1"))
    b = edges.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("type").alias("t2"), F.col("confidence").alias("c2"))
    pattern = F.lit(None).cast("string")
    for (x, y), name in HINTS.items():
        pattern = F.when((F.col("t1") == x) & (F.col("t2") == y), F.lit(name)).otherwise(pattern)
    # only edges of the types that make hints meet, and only the best of those with the same ends and type
    first = a.where(F.col("t1").isin([x for x, _ in HINTS])).transform(deal, "mid").groupBy("start", "mid", "t1").agg(F.max("c1").alias("c1"))
    then = b.where(F.col("t2").isin([y for _, y in HINTS])).transform(deal, "mid").groupBy("mid", "end", "t2").agg(F.max("c2").alias("c2"))
    d = first.join(then, "mid").where("start <> end").withColumn("pattern", pattern).where("pattern is not null")
    return deal(d, "start", "end", "pattern").groupBy("start", "end", "pattern").agg(F.max(F.col("c1") * F.col("c2")).alias("confidence"))


def validated(edges: DataFrame, ontology: DataFrame) -> DataFrame:
    """Edges (with from_type, to_type) and `errors`, against (type, domain array, range array), a row for each edge type."""
    d = edges.join(F.broadcast(ontology), "type", "left")
    errors = F.array_compact(F.array(
        F.when(F.col("domain").isNull(), F.lit("unknown type")),
        F.when(~F.col("confidence").between(0, 1), F.lit("confidence")),
        F.when(~F.array_contains("domain", F.col("from_type")), F.lit("domain")),
        F.when(~F.array_contains("range", F.col("to_type")), F.lit("range")),
    ))
    return d.withColumn("errors", errors).drop("domain", "range")


def with_inverses(edges: DataFrame, inverse: DataFrame) -> DataFrame:
    """Edges and, for types that have one in (type, inverse), the edge the other way; symmetric types are their own."""
    back = edges.join(F.broadcast(inverse), "type").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("inverse").alias("type"), "confidence")
    return edges.select("src", "dst", "type", "confidence").unionByName(back).groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"))


def resolved(names: DataFrame, entities: DataFrame) -> DataFrame:
    """name, entity, method: by the exact name, else by an alias, else by the name in any case (the least if several)."""
    exact = entities.select(F.col("name").alias("n"), F.col("name").alias("by_name")).distinct()
    alias = entities.select(F.explode("aliases").alias("n"), "name").groupBy("n").agg(F.min("name").alias("by_alias"))
    low = entities.groupBy(F.lower("name").alias("n")).agg(F.min("name").alias("by_case"))
    d = names.join(exact, F.col("name") == exact["n"], "left").drop("n").join(alias, F.col("name") == alias["n"], "left").drop("n").join(low, F.lower("name") == low["n"], "left").drop("n")
    method = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_case").isNotNull(), "case").otherwise("none")
    return d.select("name", F.coalesce("by_name", "by_alias", "by_case").alias("entity"), method.alias("method"))


def episodes_of(mentions: DataFrame, entities: DataFrame, terms: list[str], k: int) -> DataFrame:
    """Episodes that mention any of the terms by name or alias, those with most of them first, then the latest, with the terms."""
    named = entities.select("entity_id", F.explode(F.array_union(F.array(F.lower("name")), F.transform("aliases", lambda a: F.lower(a)))).alias("term"))
    hit = named.where(F.col("term").isin([t.lower() for t in terms])).groupBy("entity_id").agg(F.min("term").alias("term"))
    g = mentions.select("episode_id", "entity_id", "ts").join(hit, "entity_id").groupBy("episode_id").agg(F.countDistinct("entity_id").alias("shared"), F.max("ts").alias("ts"), F.sort_array(F.collect_set("term")).alias("names"))
    return g.orderBy(F.desc("shared"), F.desc("ts"), "episode_id").limit(k)


def best_match(names: DataFrame, known: DataFrame, least: float = 0.8, others: bool = False) -> DataFrame:
    """name, match, ratio: the known name nearest by Levenshtein ratio, ties to the least; with `others`, never the name itself.

    A known name of m letters is cut into one piece more than there may be edits with any partner, so a partner has one of
    the pieces whole, at a place that the edits before and after it allow. Names meet by length, piece and text only. A name is
    cut for the lengths that known names have, where it is; a pair that meets by several pieces is looked at for each, so no
    step gathers what meets before it is known to be near.
    """
    edits = lambda m: F.floor((1 - least) * F.floor(m / least + 1e-9) + 1e-9).cast("int")
    begin = lambda m, i: F.floor(i * m / (edits(m) + 1)).cast("int")
    pieces = F.sequence(F.lit(0), F.least(edits(F.col("m")), F.greatest(F.col("m") - 1, F.lit(0))))
    n, m, i = F.col("n"), F.col("m"), F.col("i")
    b = known.select(F.col("name").alias("match")).where("match is not null").distinct().select("match", F.length("match").alias("m"))
    lengths = F.broadcast(b.select("m").distinct())  # a row for each length
    b = b.select("match", "m", F.explode(pieces).alias("i")).select("match", "m", "i", F.col("match").substr(begin(m, i) + 1, begin(m, i + 1) - begin(m, i)).alias("piece"))
    a = names.select("name").where("name is not null").distinct().withColumn("n", F.length("name"))
    a = a.select("name", "n", F.explode(F.sequence(F.ceil(n * least - 1e-9).cast("int"), F.floor(n / least + 1e-9).cast("int"))).alias("m")).join(lengths, "m")
    a = a.select("name", "n", "m", F.explode(pieces).alias("i")).withColumns({"at": begin(m, i), "size": begin(m, i + 1) - begin(m, i), "after": edits(m) - i})
    low = F.greatest(F.lit(0), F.col("at") - i, F.col("at") + n - m - F.col("after"))
    high = F.least(n - F.col("size"), F.col("at") + i, F.col("at") + n - m + F.col("after"))
    cut = F.array_distinct(F.transform(F.sequence("low", "high"), lambda at: F.col("name").substr(at + 1, F.col("size"))))
    a = a.withColumns({"low": low, "high": high}).where("low <= high").select("name", "m", "i", F.explode(cut).alias("piece"))
    pairs = a.join(b, ["m", "i", "piece"]).select("name", "match")
    pairs = pairs.where("name <> match") if others else pairs
    longest = F.greatest(F.length("name"), F.length("match"))
    d = pairs.withColumn("ratio", F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("name", "match") / longest)).where(F.col("ratio") >= least)
    return d.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("ratio"), "match")).alias("x")).select("name", "x.match", (-F.col("x.ratio")).alias("ratio"))


def with_alias_arrays(entities: DataFrame) -> DataFrame:
    """Entities with an empty array where there are no aliases."""
    return entities.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def union_of_stores(stores: dict[str, DataFrame]) -> DataFrame:
    """All agents' stores as one, with `agent`; columns that a store lacks are null."""
    parts = [d.withColumn("agent", F.lit(name)) for name, d in stores.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def linked(links: DataFrame, known: DataFrame, other: str) -> DataFrame:
    """The other ends, `memory_id` or `episode_id`, of links whose one end is in known; each once."""
    key = next(c for c in ("memory_id", "episode_id") if c != other)
    return links.join(known.select(key).distinct(), key, "left_semi").select(key, other).distinct()
