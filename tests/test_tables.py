"""Table functions against the DataFrame forms, and what they refuse."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspur.functions import chunks, tables
from larkspur.operators import retrieval

ROWS = [(1, "# A\nline one. line two\n\nmore", "x"), (2, None, "y"), (3, "", None), (4, "word " * 300, "z"), (None, "é" * 90, "q")]


@pytest.fixture
def docs(spark):
    d = spark.createDataFrame(ROWS, "id long, Text string, kind string")
    d.createOrReplaceTempView("rows_of_text")
    tables.register(spark, d.select("id", F.col("Text").alias("text")), {"none": lambda window: -1})
    return d


def test_chunks_equal_the_dataframe_form(spark, docs):
    got = spark.sql("SELECT id, chunk, start_line, end_line, chunk_text, hash FROM markdown_chunks(TABLE(rows_of_text), text => 'text', tokens => 10, overlap => 2)")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, chunks.markdown_chunks(docs, "id", "text", 10, 2).collect())))
    assert got.schema["id"].dataType == docs.schema["id"].dataType
    assert spark.sql("SELECT * FROM markdown_chunks(TABLE(rows_of_text))").columns == ["id", "kind", "chunk", "start_line", "end_line", "chunk_text", "hash"]


def test_pieces_by_named_breaks(spark, docs):
    for at, where in (("sentence", tables.BREAKS["sentence"]), ("none", lambda window: -1), ("last_break", chunks.at_last_break)):
        got = spark.sql(f"SELECT id, piece, piece_text FROM message_pieces(TABLE(rows_of_text), most => 12, at => '{at}')").collect()
        want = [(i, k, t) for i, text, _ in ROWS if text is not None for k, t in enumerate(chunks.at_breaks(text, 12, where))]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert spark.sql("SELECT max(octet_length(piece_text)) FROM byte_pieces(TABLE(rows_of_text), most => 7)").head()[0] <= 7


def test_what_they_refuse(spark, docs):
    for bad in ("markdown_chunks(TABLE(rows_of_text), text => 'body')", "message_pieces(TABLE(rows_of_text), at => 'nowhere')", "markdown_chunks('rows_of_text')", "byte_pieces(TABLE(SELECT id AS piece, text FROM rows_of_text))"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_search_and_reading(spark, docs):
    got = spark.sql("SELECT * FROM memory_search('line Word WORD', 3) ORDER BY score DESC, id").collect()
    want = retrieval.bm25(docs.withColumnRenamed("Text", "text"), "id", "text", ["line", "word"], 3).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert [tuple(r) for r in spark.sql("SELECT * FROM memory_get(1, 2, 1)").collect()] == [(1, "line one. line two")]
    assert spark.sql("SELECT * FROM memory_search('', 3)").collect() == []
