"""Texts in pieces. Each piece depends on where the one before it ended, so a text is walked in Python, batches at a time."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_lines(text: str, tokens: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of chunks of whole lines up to tokens * 4 characters, 32 at least.

    A line that is longer is cut. Each chunk begins with the last lines of the one before, as few as make up
    overlap * 4 characters.
    """
    most, carry = max(32, tokens * 4), max(0, overlap * 4)
    pieces = [(n, line[i : i + most]) for n, line in enumerate(text.split("\n"), 1) for i in range(0, max(1, len(line)), most)]
    out: list[tuple[int, int, str]] = []
    held: list[tuple[int, str]] = []
    size = 0
    for piece in pieces:
        cost = len(piece[1]) + 1
        if held and size + cost > most:
            out.append((held[0][0], held[-1][0], "\n".join(p for _, p in held)))
            kept, back = 0, len(held)
            while carry and back and kept < carry:
                back -= 1
                kept += len(held[back][1]) + 1
            held, size = held[back:], kept
        held.append(piece)
        size += cost
    return [*out, (held[0][0], held[-1][0], "\n".join(p for _, p in held))]


def markdown_chunks(docs: DataFrame, id_col: str, text_col: str, tokens: int = 400, overlap: int = 80) -> DataFrame:
    """id, chunk (from 0), start_line, end_line, text, hash; null texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, a, e, t, hashlib.sha256(t.encode()).hexdigest()) for i, text in zip(b["id"], b["text"], strict=True) if text is not None for k, (a, e, t) in enumerate(by_lines(text, tokens, overlap))]
            yield pd.DataFrame(rows, columns=["id", "chunk", "start_line", "end_line", "text", "hash"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, chunk int, start_line int, end_line int, text string, hash string")


def remapped(chunks: DataFrame, line_map: Column) -> DataFrame:
    """Chunks with their lines as the source's, by an array of source lines; lines beyond it stay."""
    at = lambda c: F.coalesce(F.get(line_map, F.col(c) - 1), F.col(c))
    return chunks.withColumns({"start_line": at("start_line"), "end_line": at("end_line")})


def by_bytes(text: str, most: int) -> list[str]:
    """Pieces of at most `most` bytes of UTF-8 (one character at least), cut between characters."""
    raw = text.encode()
    if most <= 0 or len(raw) <= most:
        return [text]
    out, at = [], 0
    while at < len(raw):
        end = min(at + most, len(raw))
        while end < len(raw) and end > at and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            end += 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
        out.append(raw[at:end].decode())
        at = end
    return out


def byte_pieces(text: Column, most: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else by_bytes(x, most))

    return run(text)


def at_breaks(text: str, limit: int, where: Callable[[str], int]) -> list[str]:
    """Pieces of at most `limit` characters, cut where the caller says in each window; spaces at the cuts go."""
    out = []
    while limit > 0 and len(text) > limit:
        cut = where(text[:limit])
        cut = cut if 0 < cut <= limit else limit
        if piece := text[:cut].rstrip():
            out.append(piece)
        text = text[cut:].lstrip()
    return [*out, text] if text else out


def at_last_break(window: str) -> int:
    """The last line end of a window, or else its last space."""
    return max(window.rfind("\n"), -1) if "\n" in window else window.rfind(" ")


def message_pieces(text: Column, limit: int, where: Callable[[str], int] = at_last_break) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else at_breaks(x, limit, where))

    return run(text)


def compression_ratio(text: Column) -> Column:
    """Compressed size as a share of the text's, by the strongest deflate; null for null and empty texts."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: len(zlib.compress(x.encode(), 9)) / len(x.encode()) if x else None).astype("float64")

    return run(text)
