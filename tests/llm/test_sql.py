"""The operators' queries against their SQL on DuckDB."""

import duckdb
import pytest

from trackloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("n", range(1, 14))
def test_registered(n):
    assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
