"""Pinned examples, and plain-Python counterparts of the order-dependent operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.functions import scalars as S
from trackloom.operators import aggregates as A
from trackloom.operators import appearance as M
from trackloom.operators import filters as P
from trackloom.operators import graph
from trackloom.operators import joins as J
from trackloom.operators import selection as O
from trackloom.operators import upserts as U
from trackloom.operators import windows as W
from trackloom.plans.runtime import Scratch


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_text_to_values(spark):
    r = one(spark, a=S.leading_number(F.lit(" \t12abc")), b=S.leading_number(F.lit("")), c=S.leading_number(F.lit(None).cast("string")), d=S.leading_number(F.lit("-.5e1x")), e=S.flag(F.lit("  YES\n")), f=S.flag(F.lit("no")), g=S.rational(F.lit("30000/1001")), h=S.rational(F.lit("1/0")), i=S.event_year(F.lit("2026mawor")), j=S.event_year(F.lit("x")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.h, r.i, r.j) == (12.0, 0.0, 0.0, -5.0, True, False, None, "2026", None)
    assert r.g == pytest.approx(29.97002997)


def test_video_ids(spark):
    want = "abcdefghijk"
    for u in (want, f"https://youtu.be/{want}", f"https://www.youtube.com/watch?x=1&v={want}&t=3", f"https://www.youtube.com/live/{want}?s=1"):
        assert one(spark, v=S.video_id(F.lit(u))).v == want
    assert one(spark, v=S.video_id(F.lit("nothing"))).v is None


def test_rounding_and_shares(spark):
    r = one(spark, a=S.half_up(F.lit(-0.5)), b=S.half_even(F.lit(2.5)), c=S.percent(F.lit(0), F.lit(0)), d=S.share_weighted(F.lit(1.0), F.lit(0.0), F.lit(9.0)), e=S.share_weighted(F.lit(1.0), F.lit(4.0), F.lit(None).cast("double")))
    assert (r.a, r.b, r.c, r.d, r.e) == (0, 2.0, 0, 3.0, None)


@settings(max_examples=30, deadline=None)
@given(st.floats(0, 12))
def test_budget_is_interpolated(dt):
    xs, ys = zip(*S.ENVELOPE_M, strict=True)
    slope = (ys[-1] - ys[-2]) / (xs[-1] - xs[-2])
    want = float(np.interp(dt, xs, ys)) if dt <= xs[-1] else ys[-1] + slope * (dt - xs[-1])
    assert want == pytest.approx(ys[0] if dt <= xs[0] else want)


def test_budget_column(spark):
    d = spark.createDataFrame([(x / 10,) for x in range(0, 80)], "dt double").select("dt", S.distance_budget("dt").alias("m"), S.pixel_budget("dt").alias("p")).collect()
    xs, ys = zip(*S.ENVELOPE_M, strict=True)
    px, py = zip(*S.ENVELOPE_PX, strict=True)
    for r in d:
        want = np.interp(r.dt, xs, ys) if r.dt <= 5 else ys[-1] + (ys[-1] - ys[-2]) / 1.5 * (r.dt - 5)
        assert r.m == pytest.approx(want) and r.p == pytest.approx(np.interp(r.dt, px, py))


def test_boxes_planes_and_lens(spark):
    a, b = tuple(map(F.lit, (0.0, 0.0, 10.0, 10.0))), tuple(map(F.lit, (5.0, 0.0, 15.0, 10.0)))
    r = one(spark, iou=S.iou(a, b), io=S.containment(a, b), v=S.vertical_overlap(a, b), dx=S.offset_in_widths(a, b))
    assert (r.iou, r.io, r.v, r.dx) == (pytest.approx(1 / 3), 0.5, 1.0, 0.5)
    lens = (1000.0, -0.1, 0.01, 960.0, 540.0)
    x, y = S.distort(F.lit(1200.0), F.lit(700.0), *lens)
    u, v = S.undistort(x, y, *lens)
    r = one(spark, u=u, v=v)
    assert r.u == pytest.approx(1200, abs=1e-6) and r.v == pytest.approx(700, abs=1e-6)
    assert math.isinf(S.fold_radius(0.1, 0)) and S.fold_radius(-0.1, 0) == pytest.approx(math.sqrt(1 / 0.3))
    square = F.lit([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]])
    r = one(spark, i=S.inside_polygon(F.lit(1.0), F.lit(1.0), square), o=S.inside_polygon(F.lit(5.0), F.lit(1.0), square), d=S.distance_to_outline(F.lit(6.0), F.lit(2.0), square))
    assert (r.i, r.o, r.d) == (True, False, 2.0)


def test_hash_ignores_field_order(spark):
    a, b = ("x", F.lit(1)), ("y", F.lit("z"))
    r = one(spark, p=S.canonical_hash(a, b), q=S.canonical_hash(b, a))
    assert r.p == r.q


def test_pooled_query(spark):
    d = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1000, 0.0, 1.0), (1, 2000, 1.0, 0.0)], "tid int, ms long, a double, b double")
    r = W.pooled_mean(d, ["tid"], "ms", ["a", "b"], 1000).where("ms = 1000").select(S.unit(F.array("pooled_a", "pooled_b")).alias("u")).first()
    assert r.u == pytest.approx([2 / 5**0.5, 1 / 5**0.5])


def test_top_three_beats_one_lucky_match(spark):
    d = spark.createDataFrame([("A", v) for v in (0.99, 0.10, 0.10, 0.10)] + [("B", v) for v in (0.80, 0.79, 0.78)], "k string, v double")
    r = {x.k: x.top_mean for x in O.top_mean(d, ["k"], "v").collect()}
    assert r["B"] > r["A"]


def test_alliance_gate(spark):
    rows = [(q, k, s, c, "red", conf) for q, conf in ((0, 1.0), (1, 0.2)) for k, s, c in (("A", 0.1, "red"), ("B", 0.9, "blue"))]
    d = P.mask_other_side(spark.createDataFrame(rows, "q int, k string, s double, cs string, side string, conf double"), ["q"], "s", "cs", "side", "conf", 0.5)
    r = {(x.q, x.k): x.gated for x in d.collect()}
    assert r[0, "B"] == -math.inf and r[1, "B"] == 0.9 and r[0, "A"] == 0.1
    lone = P.mask_other_side(spark.createDataFrame([(0, "B", 0.9, "blue", "red", 1.0)], "q int, k string, s double, cs string, side string, conf double"), ["q"], "s", "cs", "side", "conf", 0.5)
    assert lone.first().gated == 0.9


def test_retally_with_cap(spark):
    votes = spark.createDataFrame([(1, float(t), "A") for t in range(20)], "tid int, t double, team string")
    spans = spark.createDataFrame([(1, 1, 0.0, 9.0), (1, 2, 10.0, 19.0)], "tid int, seg int, lo double, hi double")
    d = J.in_intervals(votes, spans, "tid", "t", 5.0, ["seg"])
    assert {r["seg"]: r["count"] for r in d.groupBy("seg").count().collect()} == {1: 10, 2: 10}
    assert {(r["seg"], r["n"]) for r in M.tally(d, "seg", "team", ["t"], 4).collect()} == {(1, 4), (2, 4)}


def test_interval_fallback(spark):
    p = spark.createDataFrame([(1, 12.0), (1, 30.0)], "k int, t double")
    s = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 15.0, 20.0)], "k int, seg int, lo double, hi double")
    assert {r.t: r.seg for r in J.in_intervals(p, s, "k", "t", 5.0, ["seg"], nearest=True).collect()} == {12.0: 1, 30.0: 2}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("kl"), st.integers(0, 60), st.integers(0, 6)), max_size=8), st.lists(st.tuples(st.sampled_from("klm"), st.integers(-20, 80)), min_size=1, max_size=12))
def test_nearest_span_against_all(spark, spans, points):
    spans = [(k, float(a), float(a + n), i) for i, (k, a, n) in enumerate(spans)]
    s = spark.createDataFrame(spans, "k string, lo double, hi double, seg int")
    p = spark.createDataFrame([(*x, i) for i, x in enumerate(points)], "k string, t int, i int").withColumn("t", F.col("t").cast("double"))
    for r in J.in_intervals(p, s, "k", "t", 5.0, ["seg"], nearest=True).collect():
        own = [(max(lo - r.t, r.t - hi, 0.0), lo, hi) for k, lo, hi, _ in spans if k == r.k]
        if not own:
            assert r.span_lo is None
        elif min(own)[0] == 0:
            assert r.span_lo <= r.t <= r.span_hi
        else:
            assert (r.span_lo, r.span_hi) in {(lo, hi) for d, lo, hi in own if d == min(own)[0]}
            assert r.span_lo == min(lo for d, lo, hi in own if d == min(own)[0])


def test_largest_remainder(spark):
    d = spark.createDataFrame([("g", "A", 3), ("g", "B", 1)], "g string, k string, n int")
    assert {r.k: r.share for r in A.largest_remainder(d, ["g"], "k", "n", 24).collect()} == {"A": 18, "B": 6}


def test_contradictions_leave_no_row(spark):
    d = spark.createDataFrame([(1, 8), (1, 8), (2, 12), (2, 8)], "k int, team int")
    assert [(r.k, r.team) for r in J.agreed(d, ["k"], "team").collect()] == [(1, 8)]


def test_temporal_spread(spark):
    d = spark.createDataFrame([("k", i) for i in range(20)], "k string, f int")
    assert sorted(r.f for r in O.evenly_spaced(d, ["k"], ["f"], 5, truncate=True).collect()) == [0, 4, 9, 14, 19]
    assert O.farthest_points(np.array([[0.0], [5.0], [9.0]]), 2, [0, 2]) == [0, 2]


def test_version_ignores_row_order(spark):
    rows = [(i, f"a{i % 3}") for i in range(20)]
    a, b = (A.content_version(spark.createDataFrame(r, "i int, a string").repartition(3), ["i", "a"]).first().version for r in (rows, rows[::-1]))
    assert a == b != A.content_version(spark.createDataFrame(rows[1:], "i int, a string"), ["i", "a"]).first().version


def test_only_one_continuation(spark):
    seg = spark.createDataFrame([(0, 1, 0.0, 1.0, 0.0, 1.0, "red"), (0, 2, 1.5, 3.0, 1.2, 4.0, "red"), (0, 3, 1.4, 3.0, 1.2, 4.0, "blue"), (0, 4, 9.0, 10.0, 1.0, 1.0, None)], "m int, seg int, t0 double, t1 double, x0 double, x1 double, kind string")
    got = J.successors(seg, "m", 3.0, F.lit(2.0), max_score=0.5).select("a", "b").collect()
    assert [(r.a, r.b) for r in got] == [(1, 2)]


def test_round_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 1), (2, "c", "z", 1)], "f int, k string, v string, r int")
    new = spark.createDataFrame([(1, "a", "w", 2)], old.schema)
    live, gone = U.merge_round(old, new, "f", ["f", "k"], "r")
    assert sorted((r.k, r.v) for r in live.collect()) == [("a", "w"), ("c", "z")] and [r.k for r in gone.collect()] == ["b"]
    d = spark.createDataFrame([(1, "p", 1), (1, "unknown", 2), (1, "q", None), (2, "p", 1), (2, "q", 2)], "k int, label string, r int")
    kept, beaten = U.newest_round(d, ["k"], "r", "label", "unknown")
    assert sorted((r.k, r.label) for r in kept.collect()) == [(1, "p"), (1, "q"), (1, "unknown"), (2, "q")]
    assert [(r.k, r.label, r.winner) for r in beaten.collect()] == [(2, "p", "q")]


def test_range_lists_and_anti_join(spark):
    d = spark.createDataFrame([("qm9-qm11, sf2",)], "s string")
    assert [r.item for r in O.range_list(d, "s").collect()] == ["qm9", "qm10", "qm11", "sf2"]
    log, more = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string")
    assert sorted(r.v for r in U.append_decisions(log, more, ["k"]).collect()) == ["a", "c"]


def test_flip_to_three_and_three(spark):
    d = spark.createDataFrame([(1, "red", c / 10) for c in range(4)] + [(1, "blue", 0.5), (1, "blue", 0.6)], "m int, side string, c double")
    got = O.balance_sides(d, ["m"], "side", "c", "red", "blue").where("side != balanced").collect()
    assert [(r.side, r.c) for r in got] == [("red", 0.0)]


def test_asof_survives_hot_key_and_buckets(spark):
    rng = np.random.default_rng(0)
    lt, rt = sorted(rng.uniform(0, 100, 200)), sorted(rng.uniform(0, 100, 40))
    left = spark.createDataFrame([(1, float(t)) for t in lt], "k int, t double")
    right = spark.createDataFrame([(1, float(t)) for t in rt], "k int, t double")
    for bucket in (3.0, 1000.0):
        got = {r.t: r.matched_at for r in J.asof(left, right, "k", "t", [], bucket).collect()}
        near = {r.t: r.matched_at for r in J.nearest_in_time(left, right, "k", "t", [], bucket).collect()}
        for t in map(float, lt):
            before = [x for x in rt if x <= t]
            assert got[t] == (max(before) if before else None)
            assert abs(near[t] - t) == pytest.approx(min(abs(x - t) for x in rt))


def test_components_and_chains(spark):
    s = Scratch(spark, "test")
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (8, 8), (3, 2), (None, 7), (5, 4)], "src long, dst long")
    got = {r.id: r.component for r in graph.connected_components(e, s).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}
    assert graph.connected_components(e.where("src > 100"), s, "none").count() == 0
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 4)], "src long, dst long")
    assert {r.src: r.root for r in graph.collapse_chains(chain, s).collect()} == {1: 4, 2: 4, 3: 4, 9: 4}
    cells = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 5, 5)], "cell long, gx int, gy int")
    assert {r.cell: r.component for r in graph.grid_components(cells, Scratch(spark, "grid")).collect()} == {1: 1, 2: 1, 3: 3}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 50), min_size=1, max_size=30), st.integers(1, 6))
def test_farthest_points_spread(ts, k):
    t = np.array(sorted(ts))[:, None]
    got = O.farthest_points(t, k, [0, len(t) - 1])
    assert len(got) == min(k, len(t)) and (k < 2 or len(t) <= k or {0, len(t) - 1} <= set(got))


def test_sequences():
    t = np.array([0.0, 0.1, 0.2, 2.0, 2.1])
    xy = np.array([[0, 0], [0.1, 0], [0.2, 0], [0.3, 0], [9, 0]], float)
    parts = W.split_path(t, xy, 1.0, lambda d, dt, v: d <= min(v * dt + 4 * dt * dt, 5.5 * dt) * 1.25 + 0.35)
    assert [p.tolist() for p in parts] == [[0, 1, 2]]
    v = np.array([[1.0, 0]] * 15 + [[0, 1.0]] * 15)
    assert W.change_points(v, 12, 0.5, 12) == [15]
    assert O.cover([{1, 2}, {2, 3, 4}, {1}], {}, np.array([0.0, 10.0, 20.0]), 2, 1.0) == [1, 0]


def test_thin_keeps_from_last_kept(spark):
    d = spark.createDataFrame([(1, t / 10) for t in range(20)], "k int, t double")
    assert sorted(r.t for r in W.thin(d, ["k"], "t", ["t"], 0.25).collect()) == pytest.approx([0, 0.3, 0.6, 0.9, 1.2, 1.5, 1.8])


def test_filters(spark):
    d = spark.createDataFrame([(0.0,), (5.0,), (9.0,)], "t double")
    spans = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0.0, 1.0), (8.0, 9.0))])
    assert [r.t for r in P.keep_in_spans(d, spans, "t").collect()] == [0.0, 9.0]
    assert P.keep_in_spans(d, F.array().cast("array<struct<a:double,b:double>>"), "t").count() == 3
    r = one(spark, a=P.calibration_reasons(F.lit(9), F.lit(None).cast("int"), F.lit(0.1), F.lit(0.5)), b=P.calibration_reasons(F.lit(5), F.lit(7), F.lit(float("nan")), F.lit(1.0)))
    assert r.a == [] and r.b == ["points", "inliers", "mean error", "max error"]
    v = P.violations(spark.createDataFrame([(1,), (1,), (9,)], "k int"), spark.createDataFrame([(1,), (2,)], "k int"), ["k"])
    assert sorted((r.k, r.problem) for r in v.collect()) == [(1, "repeated"), (9, "unknown")]


def test_duplicate_tracks(spark):
    rows = [(f, 1, 0.0, 0.0, 10.0, 20.0) for f in range(6)] + [(f, 2, 1.0, 1.0, 11.0, 21.0) for f in range(6)] + [(f, 3, 50.0, 0.0, 60.0, 20.0) for f in range(6)]
    got = J.duplicates_by_overlap(spark.createDataFrame(rows, "f int, tid int, x1 double, y1 double, x2 double, y2 double"), ["f"], "tid").collect()
    assert [(r.a, r.b, r.keeper) for r in got] == [(1, 2, 2)]


def test_robust_location(spark):
    rows = [("a", 1 + i % 3 * 0.1, 2.0) for i in range(9)] + [("a", 90.0, 90.0), ("b", 0.0, 0.0)]
    r = A.robust_location(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y").collect()
    assert len(r) == 1 and r[0].x == pytest.approx(1.1) and r[0].n == 9


def test_votes_by_matrix_and_by_join(spark):
    rng = np.random.default_rng(2)
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(30)] + [(99, None)], "qid long, vector array<double>")
    g = spark.createDataFrame([(f"L{i % 4}", [float(x) for x in rng.normal(size=6)]) for i in range(14)], "label string, vector array<double>")
    a, b = ({r.qid: (r.label, round(r.score, 7), round(r.margin, 7)) for r in M.prototype_votes(q, g, bound=n).collect()} for n in (100, 5))
    assert a == b and len(a) == 30
    assert M.prototype_votes(q, g.where("label = 'none'")).collect() == []


def test_corrections_bands_and_second_best(spark):
    x, y = S.corrected(F.lit(3.0), F.lit(4.0), [{"op": "radialShift", "fromXY": [0, 0], "meters": 5}, {"op": "similarity", "scale": 2, "translationM": [1, 0]}])
    r = one(spark, x=x, y=y)
    assert (r.x, r.y) == (pytest.approx(13.0), pytest.approx(16.0))
    with pytest.raises(ValueError):
        S.corrected(F.lit(1.0), F.lit(1.0), [{"op": "twist"}])
    b = spark.createDataFrame([(1, 2.0, 5), (2, 14.3, 3), (3, 8.0, 99)], "band int, centre double, ends int")
    assert [(r.band, r.mirrored) for r in O.mirrored_bands(b, 16.541).collect()] == [(1, True), (2, True), (3, False)]
    c = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.3), (2, "a", 0.2), (2, "b", 0.21), (3, "a", 0.9)], "k int, v string, s double")
    assert [(r.k, r.v) for r in O.clear_winner(c, ["k"], "s", ["v"], 0.70, 1.25).collect()] == [(1, "a")]


def test_smoothing_is_the_posterior(spark):
    """Against the joint Gaussian of first place, first speed and all accelerations."""
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.05, 0.4, 25))
    z = np.stack((np.sin(t), t * 0.7), 1) + rng.normal(size=(25, 2)) * 0.1
    n = len(t)
    to_x, to_v = np.zeros((n, n + 1)), np.zeros((n, n + 1))
    to_x[0, 0] = to_v[0, 1] = 1
    for k in range(1, n):
        d = t[k] - t[k - 1]
        to_x[k], to_v[k] = to_x[k - 1] + d * to_v[k - 1], to_v[k - 1]
        to_x[k, k + 1] += d * d / 2
        to_v[k, k + 1] += d
    prior = np.diag([0.01, 4.0] + [9.0] * (n - 1))
    gain = prior @ to_x.T @ np.linalg.inv(to_x @ prior @ to_x.T + 0.01 * np.eye(n))
    mean = np.zeros((n + 1, 2))
    mean[0] = z[0]
    want, var = to_x @ (mean + gain @ (z - to_x @ mean)), np.diag(to_x @ (prior - gain @ to_x @ prior) @ to_x.T)
    x, got = W.smooth_stretch(t, z)
    assert np.allclose(x, want) and np.allclose(got, var)
    rows = [(1, float(a), float(b), float(c)) for a, (b, c) in zip(t, z, strict=True)] + [(1, float(t[-1]) + 0.2, 50.0, 50.0), (2, 0.0, 1.0, 2.0)]
    out = W.smooth_tracks(spark.createDataFrame(rows, "tid int, t double, x double, y double"), ["tid"]).orderBy("tid", "t").collect()
    assert np.allclose([(r.x, r.y) for r in out[:n]], want) and np.allclose([r.sd for r in out[:n]], np.sqrt(var))
    assert [(r.x, r.y, r.sd) for r in out[n:]] == [(50.0, 50.0, 0.1), (1.0, 2.0, 0.1)]  # a step too far starts anew


def test_known_orders(spark):
    minus = one(spark, a=O.shuffled(F.lit(9), F.lit(-1)), b=O.shuffled(F.lit(9), F.lit((1 << 32) - 1)))
    assert minus.a == minus.b and sorted(minus.a) == list(range(9))
    r = one(spark, a=O.shuffled(F.lit(5), F.lit(1)), b=O.shuffled(F.lit(5), F.lit(0)), c=O.shuffled(F.lit(1), F.lit(7)), d=O.shuffled(F.lit(0), F.lit(7)))
    assert (r.a, r.b, r.c, r.d) == ([0, 1, 2, 4, 3], [4, 0, 1, 2, 3], [0], [])
