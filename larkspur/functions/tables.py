"""Table functions: what SQL calls by name, after register(spark).

Chunkers take a table and give a row for each piece, beside the columns of the row that it came from; rows are cut where
they are, none moves. Searches and reads are functions in SQL themselves, so Catalyst plans them with the query around.

    SELECT * FROM markdown_chunks(TABLE(SELECT doc_id, text FROM documents), text => 'text', tokens => 400, overlap => 80)
    SELECT * FROM message_pieces(TABLE(documents), text => 'text', most => 500, at => 'sentence')
    SELECT * FROM memory_search('casino nation', 10)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from larkspur.functions import chunks

#: Where a window of text may be cut, by name; register(spark, breaks) adds a caller's own.
BREAKS: dict[str, Callable[[str], int]] = {
    "last_break": chunks.at_last_break,
    "line": lambda window: window.rfind("\n"),
    "sentence": lambda window: max((m.end() for m in re.finditer(r"[.!?](?=\s)|\n", window)), default=-1),
}


def _analysed(table: AnalyzeArgument, text: AnalyzeArgument | None, added: StructType) -> AnalyzeResult:
    """The table's columns bar the text, and the added ones. The text's column is found in any case."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    name = text.value if text is not None else "text"
    found = [f for f in table.dataType.fields if f.name.lower() == str(name).lower()]
    if len(found) != 1:
        raise ValueError(f"the table has no single column {name}")
    kept = [f for f in table.dataType.fields if f is not found[0]]
    clash = {f.name.lower() for f in kept} & {f.name.lower() for f in added.fields}
    if clash:
        raise ValueError(f"the table has columns of the result's names: {sorted(clash)}")
    return AnalyzeResult(StructType([*kept, *added.fields]))


def _split(row: Row, text: str | None) -> tuple[list, str | None]:
    values = row.asDict()
    name = next(k for k in values if k.lower() == (text or "text").lower())
    return [v for k, v in values.items() if k != name], values[name]


CHUNK = StructType().add("chunk", IntegerType()).add("start_line", IntegerType()).add("end_line", IntegerType()).add("chunk_text", StringType()).add("hash", StringType())
PIECE = StructType().add("piece", IntegerType()).add("piece_text", StringType())


class MarkdownChunks:
    """chunks.by_lines() of each row's text; a null text has none."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument | None = None, tokens: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analysed(table, text, CHUNK)

    def eval(self, table: Row, text: str = "text", tokens: int = 400, overlap: int = 80) -> Iterator[tuple]:
        kept, value = _split(table, text)
        for k, (a, e, t) in enumerate(chunks.by_lines(value, tokens, overlap) if value is not None else []):
            yield (*kept, k, a, e, t, hashlib.sha256(t.encode()).hexdigest())


class BytePieces:
    """chunks.by_bytes() of each row's text."""

    @staticmethod
    def analyze(table: AnalyzeArgument, text: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analysed(table, text, PIECE)

    def eval(self, table: Row, text: str = "text", most: int = 4000) -> Iterator[tuple]:
        kept, value = _split(table, text)
        for k, t in enumerate(chunks.by_bytes(value, most) if value is not None else []):
            yield (*kept, k, t)


def message_pieces(breaks: dict[str, Callable[[str], int]]) -> type:
    """chunks.at_breaks() of each row's text, cut where the named one of breaks says."""

    class MessagePieces:
        @staticmethod
        def analyze(table: AnalyzeArgument, text: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None, at: AnalyzeArgument | None = None) -> AnalyzeResult:
            if at is not None and at.value not in breaks:
                raise ValueError(f"no break is called {at.value}; there are {sorted(breaks)}")
            return _analysed(table, text, PIECE)

        def eval(self, table: Row, text: str = "text", most: int = 4000, at: str = "last_break") -> Iterator[tuple]:
            kept, value = _split(table, text)
            for k, t in enumerate(chunks.at_breaks(value, most, breaks[at]) if value is not None else []):
                yield (*kept, k, t)

    return MessagePieces


# Words of a query count once each; scores are BM25 with the usual constants, ties to the lesser id.
SEARCH = r"""CREATE OR REPLACE TEMPORARY FUNCTION memory_search(query STRING, k INT) RETURNS TABLE (id {id_type}, score DOUBLE) RETURN
WITH said AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]+', 0) AS words FROM {view} WHERE text IS NOT NULL),
held AS (SELECT id, size(words) AS length, filter(words, w -> array_contains(regexp_extract_all(lower(memory_search.query), '[a-z0-9_]+', 0), w)) AS hits FROM said WHERE size(words) > 0),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM held),
tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, length, explode(hits) AS term FROM held) GROUP BY id, length, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT id, round(sum(ln(1 + (n - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * length / mean))), 6) AS score FROM tf JOIN df USING (term) CROSS JOIN stats GROUP BY id)
SELECT id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM scored) WHERE place <= memory_search.k"""
GET = r"""CREATE OR REPLACE TEMPORARY FUNCTION memory_get(wanted {id_type}, first INT, lines INT) RETURNS TABLE (id {id_type}, text STRING) RETURN
SELECT id, array_join(slice(split(text, '\n'), greatest(1, memory_get.first), greatest(1, memory_get.lines)), '\n') FROM {view} WHERE id = memory_get.wanted"""


def register(spark: SparkSession, memories: DataFrame | None = None, breaks: dict[str, Callable[[str], int]] | None = None, view: str = "memories") -> None:
    """Makes the table functions known to the session's SQL; memory_search and memory_get read `memories` (id, text), if given."""
    spark.udtf.register("markdown_chunks", udtf(MarkdownChunks))
    spark.udtf.register("byte_pieces", udtf(BytePieces))
    spark.udtf.register("message_pieces", udtf(message_pieces(BREAKS | (breaks or {}))))
    if memories is not None:
        memories.select("id", "text").createOrReplaceTempView(view)
        names = {"view": view, "id_type": memories.schema["id"].dataType.simpleString()}
        for made in (SEARCH, GET):
            spark.sql(made.format(**names))
