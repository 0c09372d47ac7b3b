"""Results that hung on the order of rows, or on the rounding of corners."""

from pyspark.sql import functions as F

from trackloom.operators import aggregates as A
from trackloom.operators import tracks as T
from trackloom.operators import windows as W


def test_equal_weights_tie_in_any_order(spark):
    rows = [(i, "click", v) for i, v in enumerate((0.1, 0.2, 0.3))] + [(i, "view", v) for i, v in enumerate((0.3, 0.2, 0.1))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(1, *r[1:]) for r in order], "k long, side string, c double").coalesce(1)
        assert [tuple(r) for r in A.two_way_vote(df, ["k"], "side", "c", "click", "view").collect()] == [(1, 0.6, 0.6, "view")]
    odd = spark.createDataFrame([(1, "click", 1e30), (1, "view", 0.5)], "k long, side string, c double")
    assert [tuple(r) for r in A.two_way_vote(odd, ["k"], "side", "c", "click", "view").collect()] == [(1, 1e30, 0.5, "click")]


def test_means_of_runs_add_up_in_order(spark):
    # in order of time 0.1 + 0.2 + 0.3 is a little over 0.6, the other way round it is not
    rows = [(1, 0, 0.0, 5.0), (1, 1, 10.0, 0.1), (1, 1, 11.0, 0.2), (1, 1, 12.0, 0.3), (1, 2, 20.0, 5.0)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "k long, run long, t double, x double").coalesce(1)
        got = W.excursions(d, ["k"], ["t"], "t", "x", "run", 5.0, 50.0, 1.0).where("run = 1").collect()
        assert [r.mid for r in got] == [(0.1 + 0.2 + 0.3) / 3]


def test_leaps_of_just_the_limit(spark):
    # leaps of 94.5 by boxes 10.5 wide, 9 widths: here the corners' rounding told otherwise
    rows, w = [], 10.5
    for i in (0, 22, 23, 43, 92, 93, 184, 185, 186, 370):
        rows += [(1, k, i, i, float(k), v - w / 2, 0.0, v + w / 2, 5.0, v, w) for k, v in enumerate((i * 1.37, i * 1.37 + 94.5))]
    d = spark.createDataFrame(rows, "m long, f long, d long, tid long, t double, x1 double, y1 double, x2 double, y2 double, x double, w double")
    joined = spark.createDataFrame([], "m long, tid long, track long")
    got = T.sever_leaps(d, joined, "m", 1.0, 9.0, F.col("x"), F.col("w")).where("f = 1").collect()
    assert {r.d: r.new_tid != r.d for r in got} == {i: (i * 1.37 + 94.5 - i * 1.37) / w > 9 for i in {r[2] for r in rows}}
