"""Track operators on small worked examples."""

import pytest
from pyspark.sql import functions as F

from trackloom.operators import tracks as T
from trackloom.operators import windows as W
from trackloom.plans.runtime import Scratch


def test_side_change(spark):
    rows = [(1, t / 2, "red" if t < 24 else "blue") for t in range(48)]
    got = T.side_change_cuts(spark.createDataFrame(rows, "tid long, t double, side string")).collect()
    assert [(r.tid, r.cut) for r in got] == [(1, 12.0)]
    rows = [(1, t / 2, "blue" if 12 <= t < 18 else "red") for t in range(48)]  # one bin: passed over
    assert T.side_change_cuts(spark.createDataFrame(rows, "tid long, t double, side string")).collect() == []


def test_appearance_and_join_cuts(spark):
    v = [(1, t * 0.1, [1.0, 0.0] if t < 20 else [0.0, 1.0]) for t in range(40)]
    d = spark.createDataFrame(v, "tid long, t double, vector array<double>")
    assert [round(r.cut, 6) for r in T.appearance_cuts(d).collect()] == [2.0]
    v = [(1, (t if t < 20 else t + 30) * 0.1, x) for (_, _, x), t in zip(v, range(40), strict=True)]
    d = spark.createDataFrame(v, "tid long, t double, vector array<double>")
    assert [round(r.cut, 6) for r in T.join_cuts(d, d).collect()] == [pytest.approx(3.45)]


def test_label_cuts_and_segments(spark):
    lab = spark.createDataFrame([(1, 0.0, "A"), (1, 10.0, "B"), (1, 12.0, "B")], "tid long, t double, value string")
    assert [r.cut for r in T.label_change_cuts(lab).collect()] == [5.0]
    sc = spark.createDataFrame([(1, 8.0, 0.9), (1, 3.0, 0.2)], "tid long, at double, score double")
    assert [r.cut for r in T.label_change_cuts(lab, sc).collect()] == [8.0]
    s = spark.createDataFrame([(1, float(t)) for t in range(12) if t not in (4, 5, 6)], "tid long, t double")
    cuts = T.label_gap_cuts(s, lab)
    assert [r.cut for r in cuts.collect()] == [5.0]
    assert {r.t: r.segment for r in T.apply_cuts(s, cuts).collect()} == {float(t): int(t > 5) for t in range(12) if t not in (4, 5, 6)}
    assert {(r.tid, r.new_id) for r in W.renumber(T.apply_cuts(s, cuts), "tid", "segment").collect()} == {(1, 1), (1, 2)}


def test_crossing(spark):
    rows = [("p", 1, float(t), float(t), 1.0) for t in range(9)] + [("p", 2, float(t), 8.0 - t, 1.0) for t in range(9)]
    lab = spark.createDataFrame([("p", 0.0), ("p", 8.0)], "pin string, t double")
    got = T.crossing_cuts(spark.createDataFrame(rows, "pin string, tid int, t double, x double, w double"), lab).collect()
    assert sorted((r.tid, r.cut) for r in got) == [(1, 4.0), (2, 4.0)]


def test_play_windows(spark):
    rows = [(1, t * 0.25, max(0.0, min(t, 60) - 20) * 0.5, 0.0) for t in range(120)]
    d = spark.createDataFrame(rows, "tid long, t double, x double, y double")
    r = T.moving_window(d).first()
    assert r.start == pytest.approx(5.0, abs=0.6) and r.stop == pytest.approx(15.5, abs=0.6)
    big = d.withColumn("x", F.col("x") * 20)
    r = T.hot_span(big).first()
    assert r.lo <= 4 and 15 <= r.hi <= 22
    # a second match that rests at another time changes nothing in the first
    two = d.withColumn("match", F.lit("a")).unionByName(d.withColumn("match", F.lit("b")).withColumn("t", F.col("t") + 40))
    got = {r.match: r for r in T.moving_window(two, by=["match"]).collect()}
    assert (got["a"].start, got["a"].stop) == tuple(T.moving_window(d).first()) and got["b"].start == got["a"].start + 40
    spans = {r.match: (r.lo, r.hi) for r in T.hot_span(two.withColumn("x", F.col("x") * 20), by=["match"]).collect()}
    assert spans["a"] == tuple(T.hot_span(big).first()) and spans["b"][0] > spans["a"][1]


def test_handovers_jumps_gaps(spark):
    sp = spark.createDataFrame([("A", 1, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0), ("A", 2, 1.2, 2.0, 9.0, 0.0, 9.0, 0.0), ("A", 3, 9.0, 9.5, 0.0, 0.0, 0.0, 0.0)], "team string, tid int, t0 double, t1 double, x0 double, y0 double, x1 double, y1 double")
    assert [(r.tid, r.next_tid) for r in T.handover_conflicts(sp).collect()] == [(1, 2)]
    s = spark.createDataFrame([("A", 0.0, 0.0, 0.0, 1), ("A", 0.5, 9.0, 0.0, 2), ("A", 2.5, 9.0, 0.0, 2)], "team string, t double, x double, y double, src int")
    assert [r.t for r in T.jumps(s, source="src").collect()] == [0.5]
    assert [(r.tStart, r.reason) for r in T.route_gaps(s).orderBy("tStart").collect()] == [(0.0, "teleport"), (0.5, "unobserved")]


def test_pins(spark):
    lab = spark.createDataFrame([(1, "A", None), (2, "A", None), (2, "B", None), (3, "A", None), (3, None, "mixed"), (4, "B", None), (4, None, "unknown")], "tid long, team string, flag string")
    assert sorted((r.tid, r.team) for r in T.pins(lab).collect()) == [(1, "A"), (4, "B")]
    pieces = spark.createDataFrame([(7, 1, 0.0, "red"), (7, 2, 1.0, None), (7, 3, 2.0, "red"), (7, 5, 1.5, "blue")], "orig int, tid long, t0 double, side string")
    pinned = spark.createDataFrame([(1, "A"), (3, "A")], "tid long, team string")
    sides = spark.createDataFrame([("A", "red")], "team string, side string")
    none = spark.createDataFrame([], "a long, b long")
    assert [(r.tid, r.team) for r in T.sandwich_pins(pieces, pinned, none, sides).collect()] == [(2, "A")]
    seen = spark.createDataFrame([(1, 2)], "a long, b long")
    assert T.sandwich_pins(pieces, pinned, seen, sides).collect() == []
    votes = spark.createDataFrame([(1, 3, 10), (3, 9, 1)], "tid long, votes int, dets int")
    got = T.split_same_team(pinned, spark.createDataFrame([(1, 3)], "a long, b long"), votes)
    assert {r.tid: r.hard for r in got.collect()} == {1: False, 3: True}
    lab = spark.createDataFrame([(2, "blue"), (1, "red"), (5, "red"), (5, "blue")], "tid long, side string")
    assert {r.tid: r.side for r in T.colour_pieces(pieces, lab, pinned).collect()} == {1: "red", 2: "blue", 3: "red", 5: "blue"}


def test_conflicts_and_takers(spark):
    lab = spark.createDataFrame([(1, 1, "A", 0.0, 0.0, 0.0), (2, 2, "A", 1.0, 50.0, 0.0), (3, 1, "B", 2.0, 0.0, 0.0)], "tid long, orig int, team string, t double, x double, y double")
    none = spark.createDataFrame([], "a long, b long")
    assert sorted((r.kind, r.a, r.b) for r in T.label_conflicts(lab, none).collect()) == [("disagree", 1, 3), ("impossible", 1, 2)]
    st = spark.createDataFrame([(1, "A", "red", 1.0, 2.0, 0.0, 0.0)], "sid int, donor string, side string, t0 double, t1 double, x double, y double")
    sides = spark.createDataFrame([("A", "red"), ("B", "red"), ("C", "red"), ("D", "blue")], "team string, side string")
    present = spark.createDataFrame([("B", 1.5), ("C", 9.0)], "team string, t double")
    ends = spark.createDataFrame([("C", 0.9, 0.1, 0.0)], "team string, t double, x double, y double")
    assert [(r.sid, r.team) for r in T.unique_taker(st, ends, sides, present).collect()] == [(1, "C")]
    rows = [("A", tid, t * 0.2, 0.0 if tid == 1 else 50.0, 0.0, 2.0, 0.1) for tid in (1, 2) for t in range(20)]
    s = spark.createDataFrame(rows, "team string, tid long, t double, x double, y double, w double, v double")
    assert [(r.a, r.b) for r in T.custody_conflicts(s, s.select("t").distinct()).collect()] == [(1, 2)]
    # two matches: conflicts within one, and none between them
    many = s.withColumn("m", F.lit(1)).unionByName(s.where("tid = 1").withColumn("tid", F.col("tid") + 6).withColumn("x", F.lit(90.0)).withColumn("m", F.lit(2)))
    got = T.custody_conflicts(many, many.select("m", "t").distinct(), match="m").collect()
    assert [(r.m, r.team, r.a, r.b) for r in got] == [(1, "A", 1, 2)]


def test_holds_and_measures(spark):
    deaths = spark.createDataFrame([("r", 1, 10.0), ("r", 2, 50.0)], "region string, tid long, t double")
    births = spark.createDataFrame([("r", 9, 14.0)], "region string, tid long, t double")
    occ = spark.createDataFrame([(55.0, 6), (12.0, 5)], "t double, n int")
    assert {r.tid: (r.until, r.born) for r in T.holds(deaths, births, occ).collect()} == {1: (14.0, 9), 2: (55.0, None)}
    r = spark.createDataFrame([("A", t * 0.2, float(t if t < 10 else 10), 0.0) for t in range(30)], "team string, t double, x double, y double")
    m = T.max_speed(r).first()
    assert m.speed == pytest.approx(5.0) and m.t == pytest.approx(0.0) and not m.bracketed
    s = spark.createDataFrame([("A", 0.0, 1.0), ("B", 0.0, 15.0), ("C", 0.0, 14.0), ("D", 0.0, 2.0), ("E", 0.0, 15.5), ("F", 0.0, 1.5)], "team string, t double, x double")
    sides = spark.createDataFrame([("A", "red"), ("D", "red"), ("C", "red"), ("B", "blue"), ("E", "blue"), ("F", "blue")], "team string, side string")
    assert {x.team for x in T.start_sides(s, sides).where("wrong_end").collect()} == {"C", "F"}
    lab = spark.createDataFrame([(1, 1, 0.0, 0.0, "A"), (2, 1, 500.0, 0.0, "A"), (3, 1, 9.0, 0.0, "B")], "lid int, f int, x double, y double, team string")
    box = spark.createDataFrame([(1, 1, 5.0, 0.0, "A")], "f int, bid int, bx double, by double, guess string")
    assert {x.lid: x.result for x in T.alignment(lab, box).collect()} == {1: "correct", 2: "missing", 3: "wrong"}
    sp = spark.createDataFrame([("m", -5.0, 5.0), ("m", 8.0, 30.0)], "match string, lo double, hi double")
    assert T.interval_seconds(sp, 0.0, 10.0).first().seconds == 7.0
    d = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "tid int, f int")
    got = T.retention(d, d.where("f = 1"), d.where("f < 3"), 0.5)
    assert {x.status: x.seconds for x in got.collect()} == {"named": 0.5, "present": 0.5, "missing": 0.5}


def test_one_segmentation_for_all(spark):
    """Side, looks and votes cut in turn; votes follow the piece of their time."""
    rows = [(1, float(t), "red" if t < 30 else "blue", float(t)) for t in range(60)] + [(2, float(t), "red", 0.0) for t in range(60)] + [(3, float(t), "red", 500.0) for t in range(9)]
    votes = [(2, float(t), "A" if t < 20 else "B") for t in range(0, 60, 2)] + [(1, 5.0, "C"), (1, 45.0, "D"), (3, 1.0, "A")]
    looks = [(1, float(t), [1.0, 0.0]) for t in range(60)] + [(2, float(t), [1.0, 0.0] if t < 40 else [0.0, 1.0]) for t in range(60)]
    s = spark.createDataFrame(rows, "tid long, t double, side string, x double").repartition(3)
    v = spark.createDataFrame(votes, "tid long, t double, team string")
    w = spark.createDataFrame(looks, "tid long, t double, vector array<double>")
    d, said = T.prepared(s, v, Scratch(spark, "t"), w, inside=F.col("x") < 400, spans=F.array(F.struct(F.lit(0.0).alias("a"), F.lit(57.5).alias("b"))), side={"least": 2})
    pieces = {}
    for r in d.collect():
        pieces.setdefault((r.source, r.tid), []).append(r.t)
    found = {(k[0], min(ts), max(ts)) for k, ts in pieces.items()}
    # the vote window from 18 on has more for B
    assert found == {(1, 0.0, 29.0), (1, 30.0, 57.0), (2, 0.0, 17.0), (2, 18.0, 39.0), (2, 40.0, 57.0)}
    of = {(k, t): tid for (k, tid), ts in pieces.items() for t in ts}
    mine = {(r.tid, r.t) for r in said.where("team = 'B'").collect()}
    assert mine == {(of[2, float(t)] if t < 58 else of[2, 57.0], float(t)) for t in range(20, 60, 2)}
    assert {(r.tid, r.team) for r in said.where("team in ('C', 'D')").collect()} == {(of[1, 5.0], "C"), (of[1, 45.0], "D")}
    assert d.columns == [*s.columns, "source"] and len({tid for _, tid in pieces}) == 5
