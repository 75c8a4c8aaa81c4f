"""Each query with SQL against that SQL in another engine, on the smallest tables."""

import os

import duckdb
import pytest

from galley.plans import catalog, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def text(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return "" if v is None else str(v)

    return sorted(tuple(text(dict(zip(r[0], r[1], strict=True))[n]) for n in names) for r in rows)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = [(df.columns, tuple(r)) for r in df.collect()]
    found = sql.sql(oracle.SQL[name])
    theirs = [(found.columns, r) for r in found.fetchall()]
    assert sorted(found.columns) == names
    assert plain(mine, names) == plain(theirs, names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracle.SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
