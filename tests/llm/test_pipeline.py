import os
import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import common, minhash, pii, quality, sql
from tests.llm.helpers import SF, odd_docs
from tests.llm.test_minhash import brute
from tests.llm.test_native import in_duckdb


def through(spark, docs):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF))
    return out


def test_every_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, good, unique, clean, packed = through(spark, docs)
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))

    kept = {r[0] for r in in_duckdb(docs, sql.divergence()) if r[7]}
    assert {r.doc_id for r in good.collect()} == kept

    first = {d for d, _, _, k in brute([(d, texts[d]) for d in kept]) if k}
    rows = unique.collect()
    assert {r.doc_id for r in rows} == first
    assert len(rows) == len(first)

    assert clean.columns == docs.columns
    after = {r.doc_id: r for r in clean.collect()}
    assert after.keys() == first
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    assert any(re.search(email, texts[d]) for d in first)
    assert not any(re.search(email, r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = {}
    for r in packed.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + r.length
    assert n == {d: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in after.items()}


def test_run_is_the_stages_one_after_another(spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()
    want = through(spark, spark.read.parquet(f"{SF}/documents.parquet"))[-1].select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_hard_rows_and_empty_tables_go_through(spark):
    docs = odd_docs(spark).withColumnRenamed("words", "kept")
    for frame in through(spark, docs):
        frame.collect()
    for frame in through(spark, docs.limit(0)):
        assert frame.count() == 0


def varied(n, seed):
    """English words and made-up ones: no three in a row come twice often."""
    rng = random.Random(seed)
    common = quality.COMMON["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(n))


CLASHES = ["gone_id", "a.b", "row", "kept", "spans", "new", "doc", "c0", "own", "component_id", "part", "island", "text_", "`x"]


def test_columns_of_any_name_and_case_go_through_and_texts_are_redacted(spark):
    body = varied(300, 1) + " write to bob@example.com now"
    rows = [(1, body, "en", 5, *range(14)), (1, body, "en", 5, *range(14)), (2, body + " more", None, None, *[None] * 14), (None, varied(300, 2) + " mail a@b.com", "en", 1, *range(14))]
    docs = spark.createDataFrame(rows, "Doc_Id long, Text string, LANG string, N_chars long, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in CLASHES))
    before, good, unique, clean, packed = through(spark, docs)
    assert good.columns == unique.columns == clean.columns == docs.columns
    got = clean.collect()
    assert sorted(str(r[0]) for r in got) == ["1", "1", "None"]  # rows that share an id are one document
    assert all("@" not in r[1] and "[EMAIL]" in r[1] and r[3] == len(r[1]) and r[4:] == tuple(range(14)) for r in got)
    assert packed.count() == 3


def test_redaction_never_lets_texts_pass(spark):
    with pytest.raises(ValueError):
        pii.redacted(spark.createDataFrame([(1, "a@b.com")], "doc_id long, body string"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError):
            pii.redacted(spark.createDataFrame([(1, "a@b.com")], "doc_id long, Text string"))
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert pii.redacted(spark.createDataFrame([("mail a@b.com",)], "TEXT string")).collect()[0][0] == "mail [EMAIL]"


def test_a_very_long_text_and_its_copy_go_through(spark):
    text = varied(60_000, 3) + " a@b.example.com 10.0.0.1"
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in enumerate([text, text + " more", "short"] * 2)], "doc_id long, text string, lang string, n_chars long")
    before, good, unique, clean, packed = through(spark, docs.coalesce(1))
    assert [r.doc_id for r in unique.select("doc_id").collect()] == [0]
    (row,) = clean.collect()
    assert "@" not in row.text and row.n_chars == len(row.text)
    assert packed.agg({"length": "sum"}).head()[0] == len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(row.text, add_special_tokens=False).ids) + 1


def test_results_that_are_still_to_be_read_outlive_a_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged, near = quality.verdicts(docs), minhash.near_duplicates(docs)
    corpus_pipeline.run(spark, SF)
    assert judged.count() == near.count() == docs.count()


def test_a_runs_tables_go_with_its_end(spark):
    with common.run_scope(spark) as folder:
        common.written(spark.range(3).toDF("a"), "x").count()
        with common.run_scope(spark) as inner:
            common.written(spark.range(3).toDF("a"), "x").count()
        assert not os.path.exists(inner.removeprefix("file://"))
        assert os.path.exists(folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.shared_dir(Elsewhere)
