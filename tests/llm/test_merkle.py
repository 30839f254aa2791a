"""Proofs against trees that are built node by node, for several fan-outs."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.llm import merkle, queries, sql
from tests.llm.helpers import SF, odd_docs, sample_docs


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, add=0):
    return h("".join(said(row[c] + add if c == "n_chars" and row[c] is not None else row[c]) for c in merkle.FIELDS))


def tree(leaves, k):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + k])) for i in range(0, len(levels[-1]), k)])
    return levels


def proof(levels, i, k):
    out = []
    for level in levels[:-1]:
        first = i // k * k
        run = level[first : first + k]
        out.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= k
    return out


def brute(rows, k=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    own = [sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in names]
    below = [tree([leaf(r) for r in rs], k) for rs in own]
    top = tree([t[-1][0] for t in below], k)
    out = []
    for g, (rs, t) in enumerate(zip(own, below, strict=True)):
        for i, r in enumerate(rs):
            path = proof(t, i, k) + proof(top, g, k)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            x = leaf(r, 1 if bad else 0)
            for place, others in path:
                x = h("".join([*others[:place], x, *others[place:]]))
            out.append((r["doc_id"], t[0][i], t[-1][0], top[-1][0], h("".join(o for _, os in path for o in os)), x, x == top[-1][0]))
    return sorted(out, key=str)


def test_query_against_brute_force_and_sql(spark):
    got = sorted(map(tuple, queries.queries()["op11_lookup_proofs"](spark, SF).collect()))
    assert got == sorted(brute([r.asDict() for r in sample_docs(spark).collect()]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(sql.lookup_proofs()).fetchall())
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4


@pytest.mark.parametrize("fan_out", [2, 3, 5])
def test_fan_outs_over_several_rounds(spark, fan_out, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", fan_out**2)
    rows = [(i, "s", None if i % 7 == 0 else "é" if i % 5 == 0 else "en", i, f"text {i}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    m = merkle.manifest(docs, fan_out=fan_out)
    got = m.select("doc_id", *[merkle.said(F.col(c)) for c in ("leaf", "subroot", "root")], F.sha2(merkle.siblings_of(F.col("path")), 256), (merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert all(r.ok for r in got)
    assert sorted((*r[:5],) for r in got) == sorted((*r[:5],) for r in brute([r.asDict() for r in docs.collect()], fan_out))


def test_nulls_repeated_rows_ties_and_empty_tables(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark)).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    docs = docs.withColumns({"n_chars": F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")), "grp": F.lit(1), "idx": F.lit(2), "hash": F.lit("x"), "a.b": F.lit(0)})
    got = sorted(map(tuple, merkle.checked(docs).collect()), key=str)
    assert got == brute([r.asDict() for r in docs.collect()])
    assert merkle.checked(docs.limit(0)).collect() == []
    one = docs.where("doc_id = 5").limit(1)
    assert sorted(map(tuple, merkle.checked(one).collect()), key=str) == brute([r.asDict() for r in one.collect()])


def test_every_change_of_a_column_is_found_and_only_that(spark):
    docs = sample_docs(spark).limit(40)
    rows = {r.doc_id: r for r in merkle.manifest(docs).collect()}
    for column, value in (("text", "other"), ("source", None), ("lang", "xx"), ("doc_id", -1)):
        forged = docs.withColumn("key", F.col("doc_id")).withColumn(column, F.lit(value).cast(docs.schema[column].dataType))
        for r in forged.select("key", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("leaf")).collect():
            assert r.leaf != rows[r.key].leaf
