"""Places of pattern matches in texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of found(): a document without matches has one row with null kind.
KEYS = ["row", "doc_id"]
#: Characters of context kept before a match, back to the match before it at most.
CONTEXT = 64


def once(value: Column, use) -> Column:
    """use(value) with value computed once, where an expression needs it in several places."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(number: int, pattern: str, after: bool) -> Column:
    """Matches of a pattern, with how many characters lie before each since the one before, and the last of them; with
    `after`, the first of those that follow it too."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    item = F.struct(F.lit(number).alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("gap"), F.lit("").alias("match"), F.lit("").alias("before"), *([F.lit("").alias("after")] if after else []))
    none = F.filter(F.array(item), lambda x: F.lit(False))

    def placed(m: Column) -> Column:
        def listed(gaps: Column) -> Column:
            more = lambda i: [F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")] if after else []
            return F.transform(m, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("pos"), F.length(F.get(gaps, i)).alias("gap"), x.alias("match"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), *more(i)))

        return F.when(F.size(m) > 0, once(F.split("text", pattern, -1), listed)).otherwise(none)

    return once(found, placed)


def found(docs: DataFrame, patterns: list[str], row: str | None = None, after: bool = False) -> DataFrame:
    """row, doc_id, kind (place in patterns), start, end, match, before (and after, if wanted): leftmost non-overlapping matches of each pattern.

    Positions are in code points, the end exclusive. A null text is empty. Rows are told apart by `row` (a
    column of docs, or numbers made here), so repeated doc_ids do no harm. Matches are rare next to texts: only they are dealt out, never the texts.
    """
    d = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    every = F.flatten(F.array(*[_matches(k, p, after) for k, p in enumerate(patterns)]))
    d = d.select(*KEYS, F.explode_outer(every).alias("m")).select(*KEYS, "m.*").repartition("row")
    before = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("end", before).select(*KEYS, "kind", (F.col("end") - F.length("match")).alias("start"), "end", "match", "before", *(["after"] if after else []))


def overlaps_base(is_base: Column) -> Column:
    """Whether a span shares a character with a base span of its text."""
    w = Window.partitionBy("row").orderBy("start", "kind")
    earlier = F.max(F.when(is_base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min(F.when(is_base, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(earlier > F.col("start"), F.lit(False)) | F.coalesce(later < F.col("end"), F.lit(False))


def digest(spans: DataFrame, kinds: list[str], n_base: int) -> DataFrame:
    """A row per text: doc_id, a count n_<kind> for each base kind, base_sha256 and spans, from rows (row, doc_id, kind, start, end)."""
    name = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("kind") + 1)
    said = F.concat_ws(":", name, F.col("start"), F.col("end"))
    item = F.struct("start", "kind", said.alias("said"))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{kinds[k]}") for k in range(n_base)]
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["said"]), ",")
    g = spans.groupBy("row", "doc_id").agg(*counts, F.collect_list(F.when(F.col("kind") < n_base, item)).alias("base"), F.collect_list(F.when(F.col("kind").isNotNull(), item)).alias("every"))
    return g.select("doc_id", *[f"n_{k}" for k in kinds[:n_base]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"))
