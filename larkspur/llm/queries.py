"""The opN_ queries over whole tables, and the pipeline, with SQL where it can tell their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import quality

    return quality.verdicts(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op3_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import secrets

    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import packbits

    return packbits.read_packed(packbits.write_packed(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2))


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from larkspur.llm import bpe

    ranks = _vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


def op6_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import urls

    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    return urls.judged(table(spark, sf_dir, "pages"), rules)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import bestfit

    return bestfit.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op8_bootstrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import pii

    return pii.detect(table(spark, sf_dir, "documents"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import lm

    return lm.scored(table(spark, sf_dir, "documents"))


def op11_lookup_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import merkle

    return merkle.checked(table(spark, sf_dir, "documents"))


def op12_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import decontam

    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits")


def op13_chan_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkspur.llm import whitening

    return whitening.whitened(table(spark, sf_dir, "embeddings")).drop("exact_deviation")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_learned_partitions, op2_divergence, op3_randomness, op4_bit_packing, op5_chunked_bpe, op6_boosted_trees, op7_best_fit, op8_bootstrapped, op9_circulant_minhash, op10_gated_recurrent, op11_lookup_proofs, op12_wu_manber, op13_chan_whitening, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from larkspur.llm import sql

    return sql.oracle_sql()
