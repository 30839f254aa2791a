"""Every query against its SQL in DuckDB, at the smallest scale."""

import datetime as dt
import math

import duckdb
import pytest

from larkspur.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.6f}".rstrip("0").rstrip(".").replace("-0", "0") if float(x) == 0 else f"{float(x):.6f}".rstrip("0").rstrip(".")
    return x.isoformat(sep=" ") if isinstance(x, dt.datetime) else str(x)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    text = catalog.oracle_sql().get(name)
    if text is None:
        assert got
        return
    rel = duck.execute(text)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
