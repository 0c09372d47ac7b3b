"""Pairs counted in tiles: what goes to every tile is small, and counts are as wide as they must be."""

from collections import Counter
from itertools import combinations

import pytest

from trackloom.operators import joins as J
from trackloom.plans.runtime import Scratch


def want(rows):
    seen: dict = {}
    for g, i in rows:
        seen.setdefault(g, set()).add(i)
    return Counter(p for s in seen.values() for p in combinations(sorted(s), 2))


def test_rows_go_to_tiles_as_places(spark, monkeypatch):
    kept, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a, **k: kept.setdefault(name, keep(self, df, name, *a, **k)))
    rows = [(g, f"{'long name ' * 20}{(7 * g + k) % 50}") for g in range(40) for k in range(g % 9)]
    out = J.co_occurring(spark.createDataFrame(rows * 2, "g long, i string"), ["g"], "i", 20)
    assert {(r.a, r.b): r.shared for r in out.collect()} == want(rows)
    assert dict(kept["groups"].dtypes)["_items"] == "array<smallint>"
    assert J._BLOCK**2 <= J._TILE < (2 * J._BLOCK) ** 2  # a block is as large as a matrix of bytes may be


@pytest.mark.parametrize("n", [255, 256, 70_000])
def test_counts_of_many_groups(spark, n):
    d = spark.range(n).select(J.F.col("id").alias("g"), J.F.explode(J.F.array(J.F.lit(5), J.F.lit(3), J.F.lit(4))).alias("i")).where("i != 4 or g < 7")
    got = {(r.a, r.b): r.shared for r in J.co_occurring(d, ["g"], "i").collect()}
    assert got == {(3, 5): n, (3, 4): 7, (4, 5): 7}


def test_empty_blocks_count_nothing(spark):
    rows = [(g, i) for g in range(3) for i in range(6) if (g + i) % 3]
    got = J.co_occurring(spark.createDataFrame(rows, "g long, i long"), ["g"], "i", 1).collect()
    assert {(r.a, r.b): r.shared for r in got} == want(rows) and len(got) == len(want(rows))
