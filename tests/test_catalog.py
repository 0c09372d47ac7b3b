"""Every registered library query against its SQL on DuckDB."""

import math

import duckdb
import pytest

from trackloom.plans import families as catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (1, "")
        return (0, f"{float(v):.9g}") if isinstance(v, (int, float)) and not isinstance(v, bool) else (0, str(v))

    return sorted(tuple(one(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
