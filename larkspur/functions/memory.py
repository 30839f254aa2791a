"""Memories: tags, keywords, validation, recall."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.scratch import written

# Words that give tags, the tags they give; patterns of sentiment.
TAGS = [
    (["like", "love", "enjoy", "favorite", "favourite", "prefer"], ["preference", "likes"]),
    (["play", "game", "hobby", "activity", "sport"], ["hobby", "activity"]),
    (["work", "project", "job", "career", "develop", "build"], ["work", "project"]),
    (["code", "program", "system", "database", "api", "software"], ["technical", "technology"]),
    (["friend", "family", "colleague", "partner", "team"], ["relationship", "social"]),
    (["goal", "plan", "want to", "need to", "will"], ["goal", "plan"]),
    (["learn", "study", "know", "understand", "research"], ["knowledge", "learning"]),
    (["ttrpg", "rpg", "dnd", "d&d", "tabletop", "dice"], ["ttrpg", "gaming"]),
]
SENTIMENTS = [
    (r"\b(like|love|enjoy)s?\b", "positive_sentiment"),
    (r"\b(hate|dislike|avoid)s?\b", "negative_sentiment"),
    (r"\b(use|work with|build with)\b", "tool_usage"),
    (r"\b(know|understand|familiar with)\b", "expertise"),
    (r"\b(want|plan|goal|intend)\b", "intention"),
]
CATEGORIES = ["User", "FutureTask", "CurrentProject", "SelfImprovement", "KnowledgeBase"]
MOST_TAGS = 10


def tags(text: Column, category: Column, entities: Column) -> Column:
    """Struct of tags (at most ten: category, words', entities', sentiments') and confidence (a fifth for each found)."""
    low = F.lower(text)
    given = [F.when(low.rlike("|".join(map(re.escape, words))), F.lit(t)) for words, names in TAGS for t in names]
    slugs = F.transform(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.length(e) > 2), lambda e: F.regexp_replace(F.lower(e), r"\s+", "_"))
    moods = [F.when(low.rlike(p), F.lit(t)) for p, t in SENTIMENTS]
    every = F.array_distinct(F.concat(F.array(category), F.array_compact(F.array(*given)), slugs, F.array_compact(F.array(*moods))))
    return F.struct(F.slice(every, 1, MOST_TAGS).alias("tags"), F.least(F.lit(1.0), F.size(every) / 5).alias("confidence"))


def tagged(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.where(F.arrays_overlap("tags", F.array(*[F.lit(w) for w in wanted])))


# Words without meaning of their own, by language; Korean particles, longest first.
STOP = {
    "en": "a an the this that these those i me my we our you your he she it they them is are was were be been being have has had do does did will would could should can may might in on at to for of with by from about into through during before after above below between under over and or but if then because as while when where what which who how why yesterday today tomorrow earlier later recently ago just now thing things stuff something anything everything nothing please help find show get tell give was there".split(),
    "es": "el la los las un una unos unas y o pero que de del en con por para se lo le es son fue ayer hoy cuando donde como porque sobre".split(),
    "pt": "o a os as um uma uns umas e ou mas que de do da em no na com por para se ontem hoje quando onde como porque sobre".split(),
    "zh": "的 了 着 过 吗 呢 吧 是 在 我 你 他 她 它 我们 你们 他们 这 那 这个 那个 之前 以前 之后 昨天 今天 明天 什么 怎么 哪个 为什么".split(),
    "ja": "これ それ あれ この その あの ここ そこ する した して です ます いる ある なる どう なぜ いつ そして しかし また 昨日 今日 明日".split(),
    "ko": "은 는 이 가 을 를 의 에 나 너 우리 그녀 그 저 그리고 그래서 하지만 어제 오늘 내일 대한 무엇 어떻게 왜".split(),
    "ar": "في من إلى على عن هذا هذه ذلك التي الذي كان هو هي أمس اليوم متى كيف لماذا".split(),
}
ALL_STOP = {w for ws in STOP.values() for w in ws}
PARTICLES = sorted("에서 으로 에게 한테 까지 부터 은 는 이 가 을 를 의 에 로 와 과 도 만".split(), key=len, reverse=True)
RUNS = re.compile(r"[a-z0-9_\-]+|[぀-ゟ]+|[゠-ヿー]+|[一-鿿]+|[가-힯]+|[^\W\d_]+")


def keywords(query: str) -> list[str]:
    """Words of a query that carry meaning, in order, each once. Runs of one script are words; Han runs also give pairs."""
    out: list[str] = []

    def put(word: str) -> None:
        if word not in ALL_STOP and word not in out and (len(word) > 1 or not re.match(r"[a-z぀-ヿ가-힯]", word)) and not word.isdigit():
            out.append(word)

    for run in RUNS.findall(query.lower()):
        if re.match("[一-鿿]", run):
            kept = re.split("|".join(sorted(map(re.escape, STOP["zh"] + ["昨日", "今日"]), key=len, reverse=True)), run)
            for part in kept:
                if len(part) > 1:
                    put(part)
                for i in range(len(part) - 1):
                    put(part[i : i + 2])
        elif re.match("[가-힯]", run):
            stems = [run[: -len(p)] for p in PARTICLES if run.endswith(p) and len(run) > len(p)]
            if run in ALL_STOP or any(s in ALL_STOP for s in stems):
                continue
            if stem := next((s for s in stems if len(s) > 1), None):
                put(stem)
            put(run)
        else:
            put(run)
    return out


def expanded(query: str) -> str:
    """The query's words or the query as it is, for a search by any of them."""
    words = keywords(query)
    return " OR ".join([query, *words]) if words else query


def keyword_column(query: Column) -> Column:
    """Runs of scripts and Korean stems need a walk over the text: Python, in batches."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: keywords(x or ""))

    return run(query)


def query_entities(query: Column) -> Column:
    """Capitalised words that are not at the head of common questions, and `user` for first persons."""
    caps = F.filter(F.regexp_extract_all(query, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+(?![A-Za-z0-9_])"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP["en"]))
    me = F.when(query.rlike(r"(?i)(?<![A-Za-z0-9_])(i|me|my|mine|myself)(?![A-Za-z0-9_])"), F.array(F.lit("user"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(caps, me))


def record_errors(content: Column, category: Column, confidence: Column, sources: Column, known: Column) -> Column:
    """What is wrong with an extracted record, as an array of texts."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.length(content), F.lit(0)) < 5, F.lit("content too short")),
        F.when(F.length(content) > 500, F.lit("content too long")),
        F.when(~F.coalesce(category.isin(CATEGORIES), F.lit(False)), F.lit("category")),
        F.when(~F.coalesce(confidence.between(0, 1), F.lit(False)), F.lit("confidence")),
        F.when(sources.isNull(), F.lit("sources")).when(F.size(F.array_except(sources, known)) > 0, F.lit("unknown source")),
    ))


def recalls(messages: DataFrame, injected: DataFrame, window_s: int = 300, threshold: float = 0.75, novelty: float = 0.3) -> DataFrame:
    """session, msg_id, overlap, is_recall of assistants' messages against memories injected shortly before.

    messages: session, msg_id, ts, role, content; injected: session, ts, content. A message meets the last injection's
    memories if that is not older than the window. Two texts overlap (1) if more than 0.8 of all their words are common.
    """
    words = lambda c: F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " ")), " "))
    long = lambda c: F.length(F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9_]+", " "))) > 5
    m = messages.where("role = 'assistant'").select("session", "msg_id", F.col("ts").alias("m_ts"), words(F.col("content")).alias("mw"), long(F.col("content")).alias("ml"))
    i = injected.select("session", F.col("ts").alias("i_ts"), words(F.col("content")).alias("iw"), long(F.col("content")).alias("il"))
    age = F.unix_micros(F.col("m_ts").cast("timestamp")) - F.unix_micros(F.col("i_ts").cast("timestamp"))
    # a message meets the injections of its own stretch of window_s seconds and of the one before, not a session's all
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (window_s * 1_000_000))
    m = m.withColumn("stretch", stretch("m_ts"))
    i = i.withColumn("stretch", F.explode(F.array(stretch("i_ts"), stretch("i_ts") + 1)))
    near = m.join(i, ["session", "stretch"]).where((age >= 0) & (age <= window_s * 1_000_000))
    last = F.max("i_ts").over(Window.partitionBy("session", "msg_id"))
    near = near.withColumn("last", last).where("i_ts = last")
    same = F.when(F.col("ml") & F.col("il") & (T.jaccard(F.col("mw"), F.col("iw"), 0.0) > 0.8), 1.0).otherwise(0.0)
    g = near.groupBy("session", "msg_id").agg(F.max(same).alias("overlap"))
    d = m.select("session", "msg_id").join(g, ["session", "msg_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    return d.withColumn("is_recall", (F.col("overlap") >= threshold) | (1 - F.col("overlap") < novelty))


def clean_json(raw: Column) -> Column:
    """What stands between the outermost braces, without code fences."""
    bare = F.regexp_replace(raw, r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def without_memories(text: str) -> str:
    """A text without <relevant-memories> blocks that are not in code."""
    parts = re.split(r"(```[\s\S]*?(?:```|$)|`[^`\n]*`)", text)
    kept = [p if i % 2 else re.sub(r"<\s*relevant[-_]memories\b[^>]*>[\s\S]*?(?:<\s*/\s*relevant[-_]memories\s*>|$)", "", p, flags=re.I) for i, p in enumerate(parts)]
    return "".join(kept).strip()


def visible(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else without_memories(x))

    return run(text)


#: Words of a shared gram. Texts of two words more hold a gram of whole words wherever they occur.
GRAM = 4


def _grams(text: Column) -> Column:
    """Hashes of all runs of GRAM words."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (GRAM - 1)), lambda i: F.xxhash64(F.slice(w, i, GRAM)))
    some = F.get(F.transform(F.array(F.split(text, " ")), lambda w: F.when(F.size(w) >= GRAM, runs(w))), F.lit(0))
    return some


def _inner_gram(text: Column) -> Column:
    """The least gram without the first and last word, which may be parts of longer words where the text is held; null if too short."""
    return F.array_min(_grams(F.regexp_extract(text, r"^[^ ]+ (.*) [^ ]+$", 1)))


def already_sent(texts: DataFrame, sent: DataFrame, least: int = 10, way: str = "either") -> DataFrame:
    """id of texts (id, text) that hold, or are held by, a sent text once both are made comparable; `way` is holds, held or either."""
    return sent_ways(texts, sent, least, ("holds", "held") if way == "either" else (way,)).where("holds or held").select("id")


def sent_ways(texts: DataFrame, sent: DataFrame, least: int = 10, ways: Sequence[str] = ("holds", "held")) -> DataFrame:
    """id, holds, held of the texts (id, text) that hold, or are held by, a sent text once both are made comparable; a way not in `ways` is false.

    Pairs of long texts meet by a gram of the shorter one and are confirmed. Short ones, of less than GRAM + 2 words, meet what
    holds them by marks of their characters or are found by an automaton, see _short_hits(). Null texts and those of less than
    `least` characters take no part.
    """
    keyed = texts.select("id", F.xxhash64("text").alias("h"), T.comparable(F.col("text")).alias("n")).where(F.length("n") >= least)
    a = written(keyed.withColumn("at", F.xxhash64("n")), "comparable")
    b = written(sent.select(T.comparable(F.col("text")).alias("s")).where(F.length("s") >= least).distinct().withColumn("sid", F.xxhash64("s")), "sent")
    few = lambda c: F.size(F.split(c, " ")) < GRAM + 2
    most = b.agg(F.coalesce(F.max(F.length("s")), F.lit(0))).head()[0]
    brief = a.where(F.length("n") <= most)  # no longer text is held
    found = []
    if "holds" in ways:
        met = a.select("id", F.explode(_grams(F.col("n"))).alias("g")).join(b.select("sid", _inner_gram(F.col("s")).alias("g")), "g")
        long = met.select("id", "sid").distinct().join(b, "sid").join(a, "id").where(F.contains("n", "s")).select("id", "h")
        short = _short_hits(b.where(few("s")).select(F.col("s").alias("p")), a.select("id", "h", "at", F.col("n").alias("q")), ["id", "h"], least)
        found += [d.withColumns({"holds": F.lit(True), "held": F.lit(False)}) for d in (long, short)]
    if "held" in ways:
        met = brief.select("id", _inner_gram(F.col("n")).alias("g")).join(b.select("sid", F.explode(_grams(F.col("s"))).alias("g")), "g")
        long = met.select("id", "sid").distinct().join(b, "sid").join(brief, "id").where(F.contains("s", "n")).select("id", "h")
        own = written(brief.where(few("n")).select(F.col("n").alias("p")).distinct(), "short")
        inside = _short_hits(own, b.select(F.col("sid").alias("at"), F.col("s").alias("q")), ["p"], least).distinct()
        short = brief.where(few("n")).join(inside, F.col("n") == F.col("p"), "left_semi").select("id", "h")
        found += [d.withColumns({"holds": F.lit(False), "held": F.lit(True)}) for d in (long, short)]
    ways_of = reduce(DataFrame.unionByName, found).groupBy("id", "h").agg(F.max("holds").alias("holds"), F.max("held").alias("held"))
    return a.select("id", "h").join(ways_of, ["id", "h"]).select("id", "holds", "held")


#: Characters of short texts that are sent to all tasks, whatever the size of the input.
SENT_CHARS = 1 << 20
#: Lengths from which short texts are marked by windows so long, and the lengths of the grams that a window is marked by, in shares of `least`.
WINDOWS = ((1.0, 1.0), (1.2, 1.2), (1.5, 1.2), (1.9, 1.4), (2.4, 1.6), (3.2, 1.6))
#: Characters whose marks are made at once.
MARK_CHARS = 1 << 20


def _short_hits(short: DataFrame, whole: DataFrame, keep: list[str], least: int) -> DataFrame:
    """The columns `keep` of pairs of short (p) and whole (at, q, ...) of which q holds p; at is a number that tells q.

    Short texts are told apart by their length. Lengths that few have, SENT_CHARS in all, are sent to all tasks as an automaton.
    Of the others each has a mark: the least hash of the grams in its first window. Of the windows of q all have theirs,
    neighbours mostly the same; so q has a mark of p's if it holds p, and pairs are dealt out by their marks and confirmed.
    """
    sizes = [(max(1, int(least * a)), max(1, int(least * b))) for a, b in WINDOWS]
    n = F.length("p")
    kind = reduce(lambda c, i: F.when(n >= sizes[i][0], i).otherwise(c), range(1, len(sizes)), F.lit(0))
    short = written(short.select("p", kind.alias("kind")), "kinds")
    sent, room = [], SENT_CHARS
    counts = sorted((r["n"], r["kind"]) for r in short.groupBy("kind").agg(F.sum(n).alias("n")).collect())
    while counts and counts[0][0] <= room:
        size, k = counts.pop(0)
        sent.append(k)
        room -= size
    some = [r["p"] for r in short.where(F.col("kind").isin(sent)).select("p").collect()] if sent else []
    found = _automaton_hits(some, whole, keep)
    if counts:
        used = {k: sizes[k] for _, k in counts}
        by_mark = _marked(short.where(F.col("kind").isin(list(used))), "p", used)
        met = _marked(whole, "q", used).join(by_mark, "mark").select("at", "p").distinct()
        found = found.unionByName(met.join(whole, "at").where(F.contains("q", "p")).select(*keep))
    return found


def _automaton_hits(some: list[str], whole: DataFrame, keep: list[str]) -> DataFrame:
    """keep of the rows of whole whose q holds one of some; if that is p, those of some that a q holds."""
    own = whole.sparkSession.sparkContext.broadcast(some)
    rows, held = whole.select(*([] if keep == ["p"] else keep), "q"), keep == ["p"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := automaton(own.value)) is None:
            return
        for batch in batches:
            q = batch.column(batch.num_columns - 1).to_pylist()
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(sorted({p for x in q for _, p in found.iter(x)}), pa.string())], ["p"])
            else:
                hit = pa.array([next(found.iter(x), None) is not None for x in q], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(hit) for c in batch.columns[:-1]], keep)

    return rows.mapInArrow(search, "p string" if held else ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep))


def _marked(texts: DataFrame, text: str, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """p, mark of short texts (p, kind): that of the first window of their kind; at, mark of whole ones (at, q): those of all windows of all kinds."""
    first = text == "p"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            chars = np.cumsum(pc.utf8_length(values).to_numpy(zero_copy_only=False))
            for at in np.split(np.arange(len(values)), np.flatnonzero(np.diff(chars // MARK_CHARS)) + 1):
                part = batch.slice(at[0], len(at)) if len(at) else batch.slice(0, 0)
                for kind, (window, gram) in sizes.items():
                    rows = part.filter(pc.equal(part.column(2), kind)) if first else part
                    owner, mark = window_marks(rows.column(1).to_pylist(), window, gram, kind, first)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner)), pa.array(mark)], ["p" if first else "at", "mark"])

    rows = texts.select("p", "p", "kind") if first else texts.select("at", "q")
    return rows.mapInArrow(make, "p string, mark long" if first else "at long, mark long")


def window_marks(texts: list[str], window: int, gram: int, salt: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """For the first window of each text, or all: the number of the text and the least hash of the window's grams. Of neighbours
    with the same mark one stays; texts shorter than a window have none."""
    lengths = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(len(code) - gram + 1, salt + 1, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + code[i : i + len(h)] + np.uint64(1)
    for shift in (30, 27, 31):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    least = h[: len(code) - window + 1].copy()
    for i in range(1, window - gram + 1):
        np.minimum(least, h[i : i + len(least)], out=least)
    ends = np.cumsum(lengths)
    if first:
        owner = np.flatnonzero(lengths >= window)
        return owner, least[ends[owner] - lengths[owner]].view(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + window <= ends[owner])
    owner, least = owner[inside], least[inside]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])
    return owner[new], least[new].view(np.int64)


def automaton(texts: Iterable[str]):
    """An Aho-Corasick automaton that finds all of texts; none of no texts."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for x in texts:
        made.add_word(x, x)
    if not len(made):
        return None
    made.make_automaton()
    return made


def in_memory(path: Column) -> Column:
    """Whether a relative path is a memory file, once slashes are straight and leading dots gone."""
    p = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^[./]+", "")
    return p.isin("MEMORY.md", "memory.md") | p.startswith("memory/")


def backoff(attempt: Column, first_ms: float, factor: float, most_ms: float) -> Column:
    return F.least(F.lit(float(most_ms)), first_ms * F.pow(F.lit(float(factor)), F.greatest(attempt - 1, F.lit(0))))
