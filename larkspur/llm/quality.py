"""Quality rules: a document's character classes and common words against its language's, by Jensen-Shannon distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import named, quoted, words, written
from larkspur.llm.spans import once

# Common words of the languages that have a reference.
COMMON = {
    "en": "the of and to in a is that it for on was be as with by this are at from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
# Character classes, as what they are made of. Digits are plain: a number or a key in a short text is no junk.
CLASSES = {
    "plain": "a-z0-9",
    "upper": "A-Z",
    "other_letter": r"\x{80}-\x{10FFFF}",
    "stop": ".,;:?!'\"()-",
    "space": r"\x20\x09-\x0D",
}
#: A histogram is compared only from so many characters or words on, and a document fails beyond these distances.
LEAST_CHARS, LEAST_WORDS, CLASS_LIMIT, WORD_LIMIT = 200, 200, 0.15, 0.25
#: Medians are told by counts of shares in so many steps.
STEPS = 1000


def repeated_words(word: Column) -> Column:
    """How many of the words lie in a 3-word window that the array holds twice or more.

    Each window is a long: its hash in the upper bits, its place in as few lower ones as hold it. Sorted, equal windows
    are neighbours; where those upper bits are equal the whole hashes are compared. The places of windows that have an equal
    neighbour, sorted, tell how many words they cover.
    """
    n = F.size(word)
    bits = F.length(F.bin(n))
    hashes = F.transform(word, lambda w: F.xxhash64(w))

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1)

    def window(hs: Column, i: Column) -> Column:
        return F.xxhash64(F.get(hs, i), F.get(hs, i + 1), F.get(hs, i + 2))

    def key(hs: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(hs) - 3), lambda i: F.call_function("shiftleft", window(hs, i), bits).bitwiseOR(i.cast("long"))))

    def same(hs: Column, a: Column, b: Column) -> Column:
        place = lambda x: x.bitwiseAND(mask).cast("int")
        alike = F.call_function("shiftright", a, bits) == F.call_function("shiftright", b, bits)
        return F.coalesce(F.when(alike, window(hs, place(a)) == window(hs, place(b))), F.lit(False))

    def places(hs: Column, keys: Column) -> Column:
        twice = F.filter(keys, lambda x, j: same(hs, x, F.get(keys, j - 1)) | same(hs, x, F.get(keys, j + 1)))
        return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3).cast("long"), x - s["last"])).alias("n")), lambda s: s["n"])

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(once(hashes, lambda hs: once(key(hs), lambda ks: covered(places(hs, ks)))))


def measured(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns as a struct `row`, the base figures, and `classes` and `common` (shares; null where guarded)."""
    lang = quoted(name) if (name := named(docs, "lang")) else F.lit(None).cast("string")
    lists = docs.sparkSession.createDataFrame(list(COMMON.items()), "ref_lang string, list array<string>")
    text = F.col("text")
    d = docs.select(F.struct(*map(quoted, carried)).alias("row"), F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    d = d.join(F.broadcast(lists), F.col("lang") == F.col("ref_lang"), "left").withColumn("word", words(text))
    n_chars = F.length("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    word_chars = F.length(F.array_join("word", ""))
    # what is not in words is space; the other classes are what is lost without them
    shares = [n_chars - (word_chars if k == "space" else F.length(F.regexp_replace(text, f"[{x}]+", ""))) for k, x in CLASSES.items()]
    d = d.select(
        "row", "lang", "ref_lang", n_chars.cast("long").alias("n_chars"), F.size("word").cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        (n_chars - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("word")).alias("n_repeat_words"),
        F.array(*shares).alias("class_counts"),
        F.array_remove(F.transform("word", lambda w: F.array_position("list", w)), F.lit(0).cast("long")).alias("hits"),
    )
    counted = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.size("hits") - F.size(F.array_remove("hits", k.cast("long"))))
    rest = F.aggregate("class_counts", F.col("n_chars"), lambda s, x: s - x)
    classes = F.concat(F.col("class_counts"), F.array(rest.cast("int")))
    common = F.concat(counted, F.array((F.col("n_words") - F.size("hits")).cast("int")))
    return d.select(
        "row", "ref_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("n_chars") >= LEAST_CHARS, F.transform(classes, lambda x: x / F.col("n_chars"))).alias("classes"),
        F.when(F.col("n_words") >= LEAST_WORDS, F.transform(common, lambda x: x / F.col("n_words"))).alias("common"),
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares; null where either is null."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _references(m: DataFrame) -> DataFrame:
    """A language's mean histograms."""
    means = [F.avg(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.avg(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(21)]
    refs = m.where("ref_lang is not null and not base_failed").groupBy(F.col("ref_lang").alias("of_lang")).agg(*means)
    return refs.select("of_lang", F.array(*[f"c{i}" for i in range(len(CLASSES) + 1)]).alias("ref_classes"), F.array(*[f"w{i}" for i in range(21)]).alias("ref_common"))


def _medians(m: DataFrame) -> DataFrame:
    """A language's median histograms, which junk moves little as long as it is less than half: the median of each share, to
    a thousandth, all scaled to add up to 1. Only counts of shares by their thousandths are gathered."""
    n = len(CLASSES) + 1
    nulls = lambda k: F.array_repeat(F.lit(None).cast("double"), k)
    shares = F.concat(F.coalesce("classes", nulls(n)), F.coalesce("common", nulls(21)))
    d = m.where("ref_lang is not null and not base_failed").select(F.col("ref_lang").alias("of_lang"), F.posexplode(shares).alias("k", "share")).where("share is not null")
    counts = d.groupBy("of_lang", "k", F.floor(F.col("share") * STEPS).cast("int").alias("step")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("of_lang", "k")
    upto = counts.select("of_lang", "k", "step", F.sum("c").over(w.orderBy("step")).alias("upto"), F.sum("c").over(w).alias("all"))
    middle = upto.where(F.col("upto") * 2 >= F.col("all")).groupBy("of_lang", "k").agg(((F.min("step") + 0.5) / STEPS).alias("share"))
    listed = middle.groupBy("of_lang").agg(F.array_sort(F.collect_list(F.struct("k", "share"))).alias("x"))

    def scaled(a: int, b: int) -> Column:
        own = F.transform(F.filter("x", lambda x: (x["k"] >= a) & (x["k"] < b)), lambda x: x["share"])
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(own) == b - a, F.transform(own, lambda x: x / total))

    return listed.select("of_lang", scaled(0, n).alias("ref_classes"), scaled(n, n + 21).alias("ref_common"))


def _compared(m: DataFrame, refs: DataFrame) -> DataFrame:
    """m with its distances from the references, of which there is one for each language in COMMON at most."""
    j = m.join(F.broadcast(refs), F.col("ref_lang") == F.col("of_lang"), "left")
    return j.select(*m.columns, distance(F.col("classes"), F.col("ref_classes")).alias("class_distance"), distance(F.col("common"), F.col("ref_common")).alias("word_distance"))


def judged(docs: DataFrame, carried: list[str]) -> DataFrame:
    """measured() with base_failed, class_distance, word_distance and kept.

    A language's reference is the mean histogram of those of its documents that pass the base rule and the length guards and lie
    within the limits of the median histogram, each counting once. A document fails where a histogram that its length allows
    is further from its language's than CLASS_LIMIT or WORD_LIMIT. Where the language is null or has no reference, and for
    texts below the guards, only the base rule decides. Null texts are empty and fail the base rule. Rows that share a
    doc_id stay rows of their own.
    """
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    m = written(measured(docs, carried).withColumn("base_failed", base_failed), "measured")
    figures = m.drop("row")
    first = _compared(figures, _medians(figures))
    near = first.where((F.col("class_distance") <= CLASS_LIMIT) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_LIMIT)).drop("class_distance", "word_distance")
    j = _compared(m, _references(near))
    far = (F.coalesce("class_distance", F.lit(0.0)) > CLASS_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT)
    return j.withColumn("kept", ~F.col("base_failed") & ~far)


def verdicts(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, the base figures, base_failed, kept and the two distances."""
    return judged(docs, ["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns, whatever these are called."""
    return judged(docs, docs.columns).where("kept").select("row.*")
