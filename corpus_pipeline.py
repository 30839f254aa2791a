"""The corpus pipeline: quality rules, near duplicates, personal data, packing.

Each stage works on all that the one before kept. The first three return documents with their own columns, so extra
columns go through, whatever they are called (names with dots, and names that operators use inside); the columns that a stage
needs are found as Spark finds them, so their case does not matter. The last returns the packed pieces. Null and empty texts
fail the quality rules and go there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bestfit, minhash, pii, quality
from larkspur.llm.common import remove, run_scope, shared_dir, table

#: The pipeline's rows cannot be told by SQL: its last stage encodes with a tokenizer, its third scores contexts in rounds.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the divergence from their language's reference rejects go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id.

    Rows that share a doc_id are one document and stay together; rows without a doc_id stay.
    """
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes its kind in brackets."""
    return pii.redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece."""
    import public_tokenizers

    return bestfit.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("personal data", personal_data), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each result is written to the shared folder and read again.

    What a stage's operators have written for themselves goes with its end, and its result once the next stage has read
    it; other queries' tables, and other pipelines', stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        with run_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
