"""Short excursions equal their SQL where times tie, values are missing and means end in halves."""

import datetime as dt

import pytest

from trackloom.plans import families

ZERO = dt.datetime(2024, 1, 1)


def answers(spark, tmp_path, rows):
    """``rows``: (user_id, seconds, value), written in this order."""
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa
    import pyarrow.parquet as pq

    users, seconds, values = zip(*rows, strict=True)
    n = len(rows)
    t = pa.table({"event_id": pa.array(range(n), pa.int64()), "ts": pa.array([ZERO + dt.timedelta(seconds=s) for s in seconds], pa.timestamp("us")), "user_id": pa.array(users, pa.int64()), "event_type": ["view"] * n, "value": pa.array(values, pa.float64()), "props": ["{}"] * n})
    pq.write_table(t, tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"SET threads = 1; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(families.ORACLES["short_excursions"]).fetchall())
    return sorted(map(tuple, families.QUERIES["short_excursions"](spark, str(tmp_path)).collect())), want


def test_the_first_of_rows_at_one_time_is_an_end(spark, tmp_path):
    rows = []
    for u, (a, b) in enumerate([(10.0, 200.0), (200.0, 10.0)]):
        rows += [(u, 100, 10.0), (u, 43000, a), (u, 43000, b), (u, 43300, 200.0), (u, 87000, 10.0)]
        rows += [(u + 2, 100, 10.0), (u + 2, 43300, 200.0), (u + 2, 87000, a), (u + 2, 87000, b)]
    got, want = answers(spark, tmp_path, rows)
    assert got == want and {r[0] for r in want if r[1] == 1} == {0, 2}


def test_rows_without_a_value_are_no_ends(spark, tmp_path):
    rows = [(0, 100, 10.0), (0, 43000, None), (0, 43300, None), (0, 43400, 200.0), (0, 86500, None), (0, 87000, 10.0)]
    got, want = answers(spark, tmp_path, rows)
    assert got == want == [(0, 1, 200.0)]


def test_means_that_end_in_halves(spark, tmp_path):
    rows = []
    for u, (total, n) in enumerate([(16550.69, 32), (8195.31, 32), (16810.62, 64), (205.29 * 16, 96), (939.85, 32)]):
        rows += [(u, 100, 0.0), *[(u, 43300 + k, 0.0 if k else total) for k in range(n)], (u, 87000, -100.0)]
    rows = [(u, t, v - 100 if t == 100 else v) for u, t, v in rows]
    got, want = answers(spark, tmp_path, rows)
    assert got == want and len(want) == 5
