"""What several operators of this package share: tables, scratch tables, the segment encoder."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.scratch import remove, run_scope, shared_dir, written

__all__ = ["SegmentEncoder", "batch_rows", "encoder", "hot_join", "hot_keys", "named", "quoted", "remove", "run_scope", "sampled", "shared_dir", "slices", "small_batches", "split_words", "table", "words", "written"]

#: A smaller table is joined as it is.
HOT_ROWS = 10_000
#: Separators of words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, name: str) -> str | None:
    """The column of df that Spark takes `name` for, in any case unless the session tells cases apart; none, or an error if
    several would do."""
    apart = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    found = [c for c in df.columns if c == name or not apart and c.lower() == name.lower()]
    if len(found) > 1:
        raise ValueError(f"several columns are called {name}: {found}")
    return found[0] if found else None


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def hot_keys(left: DataFrame, key: str) -> list:
    """The keys that a thousandth of left's rows or more have, a thousand at most; none of a small table."""
    n = left.count()
    return [r[0] for r in left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * 1000 >= n).select(key).collect()] if n >= HOT_ROWS else []


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list | None = None) -> DataFrame:
    """left with right's columns (null where right has no row of the key); right has one row for a key.

    hot_keys(left, key), which may be given if they are known, meet in a broadcast, however many rows they have; the
    others are dealt out by key. left is read twice, so it should be a written table.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, "left")
    kind = left.schema[key].dataType.simpleString()
    names = F.broadcast(left.sparkSession.createDataFrame([(x,) for x in hot if x is not None], f"{key} {kind}"))
    many = left.join(names, key, "left_semi").join(F.broadcast(right.join(names, key, "left_semi")), key, "left")
    return many.unionByName(left.join(names, key, "left_anti").join(right, key, "left"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Sets how many rows go to Python at once, so that long texts take little memory on either side."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, so many rows go to Python at once, so that long texts take little memory on either side; the session's own
    number is set again at the end, so what is to run with this one must be written inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sampled(df: DataFrame, key: Column, rows: int, most: int) -> DataFrame:
    """At most `most` rows of df, those with the least hashes of key; `rows` is how many df has, or a bound of that.

    From a large table only about twice as many as are wanted come to the sort.
    """
    parts = 1 << 24
    share = parts if rows <= 2 * most else 2 * most * parts // rows + 1
    h = F.xxhash64(key)
    return df.where(F.pmod(h, F.lit(parts)) < share).orderBy(F.pmod(h, F.lit(parts)), h, key).limit(most)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch's texts (null: none), A-Z lower-cased, and where each text's begin, with one more entry."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(trimmed)
    flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    ends -= ends[0]
    some = pc.not_equal(flat, "")
    if not pc.all(some).as_py():  # an empty text is split into one empty word
        stay = some.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(stay)])[ends]
        flat = flat.filter(some)
    return flat, ends


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about `most` bytes of text (at least one row each)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // most
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip([0, *ends], ends, strict=False):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


#: White space before a space or newline, or a control character that only Python calls white space.
ODD = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}][ \n]|[\x{1c}-\x{1f}]"


#: Segments of characters that neither normal form nor lower case cuts up or puts together, and the word vocabulary's words.
LATIN = r"^[\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]*$"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class SegmentEncoder:
    """Encodes texts with the tokenizers library through the segments that they share.

    A segment is a space or newline with what follows it up to the next. Pre-tokens of the byte-level vocabulary never
    reach from another character into white space, so a text's ids are those of its segments one after another; the
    word vocabulary drops white space, so there it holds for any cut at a space. Each batch is cut and its segments
    are looked up in Arrow; those not met before go to the library in one string. Texts with two white-space
    characters in a row, and texts with U+001C to U+001F, go to the library whole.
    """

    def __init__(self, path: str, drops_space: bool = False, limit: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.drops_space, self.limit = drops_space, limit
        # segments, and where in `flat` their ids begin and how many they are
        self.keys = pa.array([""], pa.string())
        self.flat, self.size = np.empty(0, dtype="<u4"), np.zeros(1, dtype=np.int32)
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        if drops_space:
            (self.mark,) = self.tok.encode("\x01", add_special_tokens=False).ids
            self.ends_word = np.array([x.endswith("</w>") for x in names])
        else:
            self.bytes_of = np.array([len(x) for x in names], dtype=np.int64)  # a character a byte

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of them each text has."""
        found = [x.ids for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), dtype="<u4"), np.array([len(x) for x in found], dtype=np.int32)

    def joined(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As plain(), by one call for all segments where the cuts can be told from the ids."""
        texts = segments.to_pylist()
        flat, _ = self.plain([(" \x01 " if self.drops_space else "").join(texts)])
        if self.drops_space:
            cuts = np.flatnonzero(flat == self.mark)
            if len(cuts) == len(texts) - 1:
                return flat[flat != self.mark], np.diff(np.concatenate([[-1], cuts, [len(flat)]])).astype(np.int32) - 1
        else:
            at = np.concatenate([[0], np.cumsum(self.bytes_of[flat])])
            want = np.concatenate([[0], np.cumsum(pc.binary_length(segments).to_numpy())])
            cuts = np.searchsorted(at, want)
            if at[-1] == want[-1] and (at[cuts] == want).all():
                return flat, np.diff(cuts).astype(np.int32)
        return self.plain(texts)

    def forget(self) -> None:
        """Keeps the segments that were met first, which are the frequent ones."""
        stay = self.limit // 6
        self.keys, self.size = self.keys.take(pa.array(np.arange(stay))), self.size[:stay].copy()
        self.flat = self.flat[: int(self.size.sum())].copy()

    def by_words(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As joined(), for Latin segments: their words are counted, and words end where the ids say so."""
        texts = segments.to_pylist()
        flat, _ = self.plain([" ".join(texts)])
        words = np.cumsum(pc.count_substring_regex(pc.utf8_lower(segments), WORD).to_numpy())
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) != (words[-1] if len(words) else 0):
            return self.joined(segments)
        return flat, np.diff(np.concatenate([[0], np.concatenate([[0], ends])[words]])).astype(np.int32)

    def learn(self, new: pa.Array) -> None:
        """Encodes segments that are not known yet."""
        # the first segment of a text has no white space to keep it from the one before
        apart = pc.match_substring(new, "\x01") if self.drops_space else pc.invert(pc.match_substring_regex(new, r"(?s)^[ \n]."))
        rest = new.filter(pc.invert(apart))
        latin = pc.match_substring_regex(rest, LATIN) if self.drops_space else pa.array(np.zeros(len(rest), dtype=bool))
        for some, encode in ((new.filter(apart), lambda x: self.plain(x.to_pylist())), (rest.filter(latin), self.by_words), (rest.filter(pc.invert(latin)), self.joined)):
            if len(some):
                flat, size = encode(some)
                self.keys = pa.concat_arrays([self.keys, some])
                self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, text after text (uint32), and where each text's begin (one more entry than texts). Null: none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.drops_space:
            odd = np.zeros(len(texts), dtype=bool)
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
            held = texts if not odd.any() else pc.if_else(pa.array(odd), "", texts)
            lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(held, " ", "\x1c "), "\n", "\x1c\n"), "\x1c")
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        place = pc.index_in(distinct, value_set=self.keys)
        if place.null_count:
            if len(self.keys) > self.limit:
                self.forget()
                place = pc.index_in(distinct, value_set=self.keys)
            self.learn(distinct.filter(pc.is_null(place)))
            place = pc.index_in(distinct, value_set=self.keys)
        first = np.cumsum(self.size, dtype=np.int32) - self.size
        code = place.to_numpy()[coded.indices.to_numpy()]
        n = self.size[code]
        upto = np.cumsum(n, dtype=np.int32)
        take = np.repeat(first[code] - (upto - n), n)
        take += np.arange(len(take), dtype=np.int32)
        ends = np.asarray(lists.offsets)
        at = np.concatenate([[0], upto])[ends - ends[0]]
        return (self.flat[take], at) if not odd.any() else self._with_odd(self.flat[take], at, texts, odd)

    def _with_odd(self, ids: np.ndarray, at: np.ndarray, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(odd)
        flat, size = self.plain(texts.take(pa.array(rows)).to_pylist())
        whole = iter(np.split(flat, np.cumsum(size)[:-1]))
        parts = [next(whole) if odd[k] else ids[at[k] : at[k + 1]] for k in range(len(odd))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool = False) -> SegmentEncoder:
    """The worker process's own encoder of a file: it is loaded once and keeps what it has learned from task to task."""
    return SegmentEncoder(path, drops_space)
