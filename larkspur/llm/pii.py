"""Personal data: base patterns, and identifiers found by contexts that are learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import hot_join, hot_keys, named, written
from larkspur.llm.spans import CONTEXT, digest, found, once, overlaps_base

KINDS = ["email", "ip", "card", "phone", "context"]
#: Possessive and tied to the first character that can begin a match, so that long runs cost no more than their length.
PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+",
    r"(?<![^\x20\x09-\x0D])[0-9]++(?:\x20[0-9]++(?=[^\x20\x09-\x0DA-Za-z0-9@]*+(?![^\x20\x09-\x0D])))++",
]
#: Tokens, and runs of digit groups, which are tokens too beside their groups.
TOKEN, GROUPED = len(PATTERNS) - 2, len(PATTERNS) - 1
#: An identifier without a base pattern has so many digits or an @. A context counts if so many different seeds have it
#: and so large a share of all its tokens are identifiers; a token is added from that score on. Scores have settled when
#: a round adds no more than SETTLED to their sum, which is less than one value that is lifted adds.
DIGITS, SUPPORT, CONFIDENCE, SCORE, SETTLED = 5, 3, 0.8, 0.8, 0.5


#: A text that is redacted is cut from blocks of so many characters.
BLOCK = 4096


def valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    ip = F.forall(F.split(match, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.substring(F.regexp_replace(x, "^0+", ""), 1, 3).try_cast("int") <= 255) | x.rlike("^0+$"))
    card = F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return (kind == 0) | F.when(kind == 1, ip).otherwise(False) | F.when(kind == 2, card).otherwise(False) | ((kind == 3) & F.length(digits).between(9, 15))


def marked(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Base spans (kind 0 to 3) and identifier-like tokens (kind 4, with `seed`: whether a base span touches it)."""
    m = found(docs, PATTERNS, row, after=True)
    kind, match = F.col("kind"), F.col("match")
    m = m.withColumn("kind", F.when((kind >= TOKEN) | valid(kind, match), kind))
    # the last two words before the token, or the one there is, tokens among them by their outlines; a run has its first group's
    w = Window.partitionBy("row", "kind").orderBy("start")
    near = lambda k: F.length(F.lag("before", k).over(w) if k else F.col("before")) < CONTEXT
    outline = lambda k: F.coalesce(F.right(shape(F.lower(F.lag("match", k).over(w))), F.lit(CONTEXT)), F.lit(""))
    earlier = F.concat(F.when(near(1), outline(2)).otherwise(""), F.lower(F.coalesce(F.lag("before", 1).over(w), F.lit(""))), outline(1))
    tail = F.concat(F.when(near(0), earlier).otherwise(""), F.lower(F.col("before")))
    m = m.withColumn("left", F.when(kind == TOKEN, F.regexp_extract(tail, r"((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++)?[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$", 1)))
    m = m.withColumn("left", F.when(kind >= TOKEN, F.max("left").over(Window.partitionBy("row", "start"))))
    # and the first two words after it, later tokens among them by their outlines
    ahead = lambda k: F.coalesce(F.left(shape(F.lower(F.lead("match", k).over(w))), F.lit(CONTEXT)), F.lit(""))
    close = lambda k: F.length(F.lead("after", k).over(w) if k else F.col("after")) < CONTEXT
    later = F.concat(ahead(1), F.lower(F.coalesce(F.lead("after", 1).over(w), F.lit(""))), F.when(close(1), ahead(2)).otherwise(""))
    head = F.concat(F.lower(F.col("after")), F.when(close(0), later).otherwise(""))
    m = m.withColumn("right", F.when(kind >= TOKEN, F.regexp_extract(head, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?)", 1)))
    m = m.withColumn("seed", (kind >= TOKEN) & overlaps_base(F.col("kind") < TOKEN)).withColumn("kind", F.when(kind >= TOKEN, TOKEN).otherwise(kind))
    value = F.regexp_replace(F.lower(match), r"^[^a-z0-9@+]+|[^a-z0-9]+$", "")
    return m.select("row", "doc_id", "kind", "start", "end", "left", "right", "seed", F.when(kind == TOKEN, value).alias("value"))


def _contexts() -> Column:
    """The names of a token's contexts: two words, or one and the value's outline, before it and after it."""
    several = r"[\x20\x09-\x0D]"
    one = lambda side, pattern: F.concat(F.regexp_extract(side, pattern, 1), F.lit(" "), shape(F.col("value")))
    return F.array_compact(F.array(
        F.when(F.col("left").rlike(several), F.concat(F.lit("2 "), "left")),
        F.when(F.col("left") != "", F.concat(F.lit("1 "), one("left", r"([^\x20\x09-\x0D]+)$"))),
        F.when(F.col("right").rlike(several), F.concat(F.lit("r2 "), "right")),
        F.when(F.col("right") != "", F.concat(F.lit("r1 "), one("right", r"^([^\x20\x09-\x0D]+)"))),
    ))


def discovered(tokens: DataFrame) -> DataFrame:
    """(value) of identifiers that no base pattern has, from tokens (doc_id, left, right, value, seed).

    Contexts and values form a graph, an edge for each pair that occurs. In each round a context's confidence is the
    mean score of its values, if SUPPORT different seeds have it, and a value's score follows from the contexts with
    CONFIDENCE or more as if they were independent; seeds keep score 1. Scores only grow, so the rounds come to an end,
    when they have settled. Everything is counted over all documents; values and contexts that very many edges have are
    not dealt out by key.

    Each context's sum of scores is kept, and a round adds what its values' scores have grown by. So all edges meet scores
    once, for the seeds; later rounds look for the edges of contexts that are good and of values that were lifted, which are few.
    """
    usable = tokens.where("value <> ''")
    edges = written(usable.select("value", "seed", F.explode(_contexts()).alias("context")).groupBy("context", "value").agg(F.max("seed").alias("seed")), "edges")
    seeds = written(edges.groupBy("value").agg(F.max("seed").alias("seed")), "seeds")
    links = edges.select("context", "value")
    hot_values, hot_contexts = hot_keys(links, "value"), hot_keys(links, "context")
    known = hot_join(links, seeds, "value", hot_values)
    sums = written(known.groupBy("context").agg(F.count(F.when(F.col("seed"), 1)).cast("double").alias("total"), F.count("*").alias("n"), F.count(F.when(F.col("seed"), 1)).alias("full")), "sums")
    scored = None
    while True:
        good = sums.where((F.col("full") >= SUPPORT) & (F.col("total") / F.col("n") >= CONFIDENCE)).select("context", F.least(F.col("total") / F.col("n"), F.lit(0.99)).alias("mean"))
        lifted = hot_join(links, written(good, "contexts"), "context", hot_contexts).where("mean is not null").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.col("mean"))))).alias("score"))
        lifted = lifted.join(seeds, "value").where("not seed").select("value", "score")
        before = lifted.withColumn("old", F.lit(0.0)) if scored is None else lifted.join(scored.select("value", F.col("score").alias("old")), "value", "left").withColumn("old", F.coalesce("old", F.lit(0.0)))
        scored = written(before, "scores")
        grown = scored.where("score > old").select("value", (F.col("score") - F.col("old")).alias("by"), ((F.col("score") >= 1) & (F.col("old") < 1)).alias("filled"))
        if (grown.agg(F.sum("by")).head()[0] or 0.0) <= SETTLED:
            break
        more = hot_join(links, grown, "value", hot_values).where("by is not null").groupBy("context").agg(F.sum("by").alias("by"), F.count(F.when(F.col("filled"), 1)).alias("filled"))
        sums = written(sums.join(more, "context", "left").select("context", (F.col("total") + F.coalesce("by", F.lit(0.0))).alias("total"), "n", (F.col("full") + F.coalesce("filled", F.lit(0))).alias("full")), "sums")
    fits = F.col("value").contains("@") | (F.length(F.regexp_replace("value", "[^0-9]", "")) >= DIGITS)
    return scored.where((F.col("score") >= SCORE) & fits).select("value")


def shape(value: Column) -> Column:
    """A value's outline: 9 for a run of digits, a for a run of letters."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "9")


def personal(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row, doc_id, kind, start, end of all personal data of every whole text; kind is null for a text without any.

    Base spans are kept as they are; tokens whose value is discovered are added where no base span touches them. Null
    texts are empty, empty tables give no rows, other columns are ignored, repeated rows stay rows of their own.
    """
    m = written(marked(docs, row), "marked")
    new = written(discovered(m.where(F.col("kind") == TOKEN)).withColumn("new", F.lit(True)), "new")
    base = m.where(F.coalesce(F.col("kind") != TOKEN, F.lit(True))).select("row", "doc_id", "kind", "start", "end")
    tokens = hot_join(m.where(F.col("kind") == TOKEN), new, "value")
    keep = F.coalesce(F.col("new") & ~F.col("seed"), F.lit(False))
    return base.unionByName(tokens.select("row", "doc_id", F.when(keep, F.col("kind")).alias("kind"), "start", "end"))


def detect(docs: DataFrame) -> DataFrame:
    """A row per text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    return digest(personal(docs), KINDS, TOKEN)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets, and n_chars, if there, as the new length.

    Spans that overlap are replaced as one, under the kind of the first. Null texts stay null. The text is the column that
    Spark takes `text` for, whatever its case; without one, or with several, it is an error, and nothing passes
    unredacted. Other columns go through as they are, whatever their names.
    """
    text_col, n_col, id_col = named(docs, "text"), named(docs, "n_chars"), named(docs, "doc_id")
    if text_col is None:
        raise ValueError("no column is called text")
    at = [f"c{i}" for i in range(len(docs.columns))]  # own names, so that none has a dot or another's name
    place = dict(zip(docs.columns, at, strict=True))
    plain = docs.toDF(*at)
    keyed = written(plain.select(F.monotonically_increasing_id().alias("row"), F.struct(*at).alias("doc")), "keyed")
    found_in = keyed.select("row", (F.col(f"doc.{place[id_col]}") if id_col else F.lit(None).cast("long")).alias("doc_id"), F.col(f"doc.{place[text_col]}").alias("text"))
    spans = personal(found_in, "row").where("kind is not null")
    w = Window.partitionBy("row").orderBy("start", "kind")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("island", F.sum(F.when(F.coalesce(F.col("start") >= upto, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), F.col("first.kind") + 1)
    merged = spans.groupBy("row", "island").agg(F.min(F.struct("start", "kind")).alias("first"), F.max("end").alias("end"))
    listed = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("first.start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), name.alias("name")))).alias("spans"))
    text = F.col(f"doc.{place[text_col]}")

    def masked(blocks: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            """Characters a to b (exclusive) from the blocks that hold them, so that no cut walks through the whole text."""
            first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
            block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
            return F.when(first == last, block(first).substr(a % BLOCK + 1, b - a)).otherwise(
                F.concat(block(first).substr(a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), block(last).substr(F.lit(1), b % BLOCK))
            )

        previous = lambda i: F.coalesce(F.get(F.col("spans"), i - 1)["end"], F.lit(0))
        parts = F.transform("spans", lambda s, i: F.concat(cut(previous(i), s["start"]), s["name"]))
        return F.concat(F.array_join(parts, ""), cut(F.element_at("spans", -1)["end"], F.length(text)))

    new = F.when(F.col("spans").isNull(), text).otherwise(once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), masked))
    out = keyed.join(listed, "row", "left").select("doc", new.alias("new"))
    cols = [F.col("new") if c == text_col else F.length("new").cast(docs.schema[c].dataType) if c == n_col else F.col(f"doc.{place[c]}") for c in docs.columns]
    return out.select(*[c.alias(name) for c, name in zip(cols, docs.columns, strict=True)])
