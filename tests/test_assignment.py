"""Names, fused boxes and colours of bounded groups."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from trackloom.operators import assignment as G


def test_best_orders(spark):
    rng = random.Random(1)
    rows = [(i, [[float(rng.randint(0, 9)) for _ in range(4)] for _ in range(4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "i long, c array<array<double>>").select("i", G.best_permutations(F.col("c"), 4).alias("b"))
    want = {i: min((sum(c[r][p[r]] for r in range(4)), list(p)) for p in permutations(range(4))) for i, c in rows}
    assert {r.i: (r.b.cost, r.b.columns) for r in df.collect()} == want
    with pytest.raises(ValueError, match="1 to 7"):
        G.best_permutations(F.col("c"), 8)


def named(spark, groups, votes, teams):
    g = spark.createDataFrame([(1, *x) for x in groups], "m long, g int, side string")
    v = spark.createDataFrame([(1, *x) for x in votes], "m long, g int, team string, n long")
    t = spark.createDataFrame([(1, *x) for x in teams], "m long, k int, team string, side string")
    return {r.g: (r.team, round(r.cost, 6)) for r in G.name_groups(g, v, t, "m", 3).collect()}


def test_groups_are_named_by_votes_and_sides(spark):
    teams = [(0, "A", "red"), (1, "B", "red"), (2, "C", "blue")]
    # both red groups vote for A, one more clearly; the blue one votes for a red team
    votes = [(0, "A", 9), (0, "B", 1), (1, "A", 6), (1, "B", 4), (2, "B", 8)]
    assert named(spark, [(0, "red"), (1, "red"), (2, "blue")], votes, teams) == {0: ("A", -40 + 10 + 50), 1: ("B", 20), 2: ("C", 20)}
    # without its side the third group gets what it votes for
    assert {g: t for g, (t, _) in named(spark, [(0, "red"), (1, None), (2, None)], votes, teams).items()} == {0: "A", 1: "C", 2: "B"}
    assert named(spark, [(0, "blue")], [], teams) == {0: ("C", 150.0)}


def fused(spark, boxes):
    df = spark.createDataFrame([([tuple(b) for b in boxes],)], "b array<struct<kind:string,x1:double,y1:double,x2:double,y2:double>>")
    return [tuple(x) for x in df.select(G.fused_boxes(F.col("b")).alias("f")).first().f]


def test_boxes_are_fused_by_kind_and_growing(spark):
    r = lambda *x: ("red", *map(float, x))
    assert fused(spark, [r(0, 0, 10, 10), r(20, 1, 30, 11), r(100, 0, 110, 10)]) == [("red", 0, 0, 30, 11, 2), ("red", 100, 0, 110, 10, 1)]
    # the third is near the second only, which has grown into the first
    assert fused(spark, [r(46, 0, 60, 10), r(0, 0, 10, 10), r(25, 0, 40, 10)]) == [("red", 0, 0, 60, 10, 3)]
    assert fused(spark, [r(0, 0, 10, 10), ("blue", 5.0, 0.0, 15.0, 10.0)]) == [("blue", 5, 0, 15, 10, 1), ("red", 0, 0, 10, 10, 1)]
    assert len(fused(spark, [r(0, 0, 10, 10), r(5, 6, 15, 16)])) == 2 and len(fused(spark, [r(0, 0, 10, 10), r(28.5, 0, 40, 10)])) == 2
    assert fused(spark, []) == []


def coloured(spark, tracks, together=(), votes=(), groups=2, **more):
    t = spark.createDataFrame([(1, *x) for x in tracks], "m long, tid long, t0 double, x0 double, y0 double, t1 double, x1 double, y1 double, n long, side string")
    p = spark.createDataFrame([(1, *x) for x in together], "m long, a long, b long")
    v = spark.createDataFrame([(1, *x) for x in votes], "m long, tid long, team string, n long")
    return {r.tid: r.g for r in G.colour_tracks(t, p, v, "m", groups, **more).collect()}


def still(tid, t0, t1, side=None, x=0.0, n=10):
    return tid, float(t0), x, 0.0, float(t1), x, 0.0, n, side


def test_colours(spark):
    assert coloured(spark, [still(1, 0, 9), still(2, 1, 9), still(3, 2, 9)], [(1, 2), (1, 3), (2, 3)]) == {1: 0, 2: 1, 3: -1}
    # seen together with 1: the other group, though the first is nearer
    assert coloured(spark, [still(1, 0, 2), still(2, 1, 3, x=50.0), still(3, 4, 5)], [(1, 2), (3, 1)]) == {1: 0, 2: 1, 3: 1}
    # the other side opens a group, and counts by the group's majority, not its last track
    assert coloured(spark, [still(1, 0, 1, "red"), still(2, 2, 3), still(3, 4, 5, "blue"), still(4, 6, 7, "blue")]) == {1: 0, 2: 0, 3: 1, 4: 1}
    # votes beat a small gap; a jump beats votes
    pair = [still(1, 0, 5), still(2, 1, 4)]
    assert coloured(spark, [*pair, still(3, 6, 7)], [(1, 2)], [(1, "A", 5), (2, "B", 5), (3, "B", 1)])[3] == 1
    assert coloured(spark, [still(1, 0, 5), still(2, 1, 4, x=400.0), still(3, 6, 7)], [(1, 2)], [(1, "A", 5), (2, "B", 5), (3, "B", 1)])[3] == 0
    # longer ones first among equal starts
    assert coloured(spark, [still(1, 0, 5, n=1), still(2, 0, 5, n=9)], [(1, 2)], groups=1) == {1: -1, 2: 0}


def test_colours_of_intervals_need_no_more_than_overlap(spark):
    rng = random.Random(5)
    rows = []
    for i in range(40):
        t0 = rng.randint(0, 60)
        rows.append(still(i, t0, t0 + rng.randint(1, 9)))
    meets = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] <= b[4] and b[1] <= a[4]]
    most = max(sum(r[1] <= t <= r[4] for r in rows) for t in range(80))
    got = coloured(spark, rows, meets, groups=most)
    assert min(got.values()) >= 0 and all(got[a] != got[b] for a, b in meets)
