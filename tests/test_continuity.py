"""Handoffs, claims in order of birth and exact naming, against going one by one."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import joins as J
from trackloom.operators import naming as N
from trackloom.operators import stitching as C
from trackloom.plans.runtime import Scratch


def in_turn(edges, margin):
    """Each fragment in order of birth takes its best free predecessor."""
    out = []
    for m in {e[0] for e in edges}:
        mine, taken = [e for e in edges if e[0] == m], set()
        for born, b in sorted({(e[3], e[2]) for e in mine}):
            free = sorted((e[4], e[1]) for e in mine if e[2] == b and e[1] not in taken)
            if free and (len(free) < 2 or free[1][0] >= margin * free[0][0]):
                taken.add(free[0][1])
                out.append((m, free[0][1], b))
    return sorted(out)


def claimed(spark, edges, margin=1.5):
    df = spark.createDataFrame(edges, "m long, a long, b long, born double, score double").repartition(3)
    return sorted((r.m, r.a, r.b) for r in C.claims(df, "m", Scratch(spark, "t"), margin).collect())


@pytest.mark.parametrize(("seed", "spread"), [(0, 3), (1, 10), (2, 40)])
def test_claims_as_if_in_turn(spark, seed, spread):
    rng = random.Random(seed)
    edges = []
    for m in range(12):
        n = rng.randint(2, 14)
        born = [rng.randint(0, 6) for _ in range(n)]  # ties too
        edges += [(m, a, b, float(born[b]), rng.randint(0, spread) / 8) for a in range(n) for b in range(n) if born[a] < born[b] and rng.random() < 0.7]
    assert claimed(spark, edges) == in_turn(edges, 1.5)


def test_claims_of_a_long_chain_and_none(spark):
    assert claimed(spark, []) == []
    # every fragment wants the one before and, less, the one before that
    edges = [(1, b - k, b, float(b), 0.1 * k) for b in range(2, 40) for k in (1, 2)]
    assert claimed(spark, edges) == in_turn(edges, 1.5)
    tied = [(1, 1, 3, 5.0, 0.5), (1, 2, 3, 5.0, 0.5), (1, 2, 4, 6.0, 0.5)]
    assert claimed(spark, tied) == [(1, 2, 4)]


FRAG = "m long, tid long, t0 double, x0 double, y0 double, t1 double, x1 double, y1 double, kind string"
OUTLINES = [(0, "tower", [[100.0, 0.0], [300.0, 0.0], [300.0, 50.0], [100.0, 50.0]], True), (1, "line", [[600.0, 0.0], [600.0, 400.0]], False)]


def found(spark, rows, **more):
    drawn = spark.createDataFrame(OUTLINES, "order int, structure string, poly array<array<double>>, closed boolean")
    gates = C.Gates(max_gap=6.0, speed=50.0, edge=10.0, **more)
    e = C.handoffs(spark.createDataFrame([(1, *r) for r in rows], FRAG), "m", gates, F.lit(50.0) + F.col("gap"), drawn)
    return {(r.a, r.b): (r.why, round(r.score, 6)) for r in e.collect()}


def test_handoffs(spark):
    one = (1, 0.0, 0.0, 0.0, 10.0, 20.0, 200.0, "red")
    assert found(spark, [one, (2, 10.0, 20.0, 200.0, 12.0, 0.0, 0.0, "red")]) == {}  # ends when the other starts
    assert found(spark, [one, (2, 10.5, 20.0, 225.0, 12.0, 0.0, 0.0, None)]) == {(1, 2): ("near", round(25 / 50.5, 6))}
    assert found(spark, [one, (2, 10.5, 20.0, 200.0, 12.0, 0.0, 0.0, "blue")]) == {}
    assert found(spark, [one, (2, 17.0, 20.0, 200.0, 18.0, 0.0, 0.0, "red")]) == {}  # too late for the plain path
    assert found(spark, [one, (2, 17.0, 20.0, 206.0, 18.0, 0.0, 0.0, "red")], still=8.0) == {(1, 2): ("still", 0.75)}


def test_handoffs_behind_structures(spark):
    left = (1, 0.0, 0.0, 0.0, 10.0, 95.0, 20.0, "red")
    # 206 across at 50 a second, and two seconds more
    assert found(spark, [left, (2, 16.1, 304.0, 20.0, 18.0, 0.0, 0.0, "red")]) == {(1, 2): ("hidden", 0.99)}
    assert found(spark, [left, (2, 16.2, 304.0, 20.0, 18.0, 0.0, 0.0, "red")]) == {}
    assert found(spark, [left, (2, 100.0, 110.0, 20.0, 118.0, 0.0, 0.0, "red")]) == {(1, 2): ("hidden", 0.25)}  # parked
    at_line = (3, 0.0, 0.0, 0.0, 10.0, 595.0, 100.0, "red")
    assert found(spark, [at_line, (4, 29.9, 605.0, 300.0, 40.0, 0.0, 0.0, "red")]) == {(3, 4): ("hidden", 0.99)}
    assert found(spark, [at_line, (2, 16.1, 304.0, 20.0, 18.0, 0.0, 0.0, "red")]) == {}


@pytest.mark.parametrize("corners", [400, 1])
def test_nearest_structure(spark, monkeypatch, corners):
    """Outlines as expressions and as one row say the same."""
    monkeypatch.setattr(C, "CORNERS", corners)
    drawn = spark.createDataFrame(OUTLINES, "order int, structure string, poly array<array<double>>, closed boolean")
    points = {1: (200.0, 25.0), 2: (95.0, 25.0), 3: (300.0, 60.0), 4: (604.0, 399.0), 5: (604.0, 420.0), 6: (450.0, 25.0)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "i int, x double, y double")
    got = {r.i: r.at_ for r in C.structure_at(df, "x", "y", drawn, "at_", 10.0).collect()}
    assert got == {1: "tower", 2: "tower", 3: "tower", 4: "line", 5: None, 6: None}


def test_tracks_of_chains(spark):
    rows = [(1, i, float(10 * i), 0.0, 0.0, 10.0 * i + 8, 0.0, 0.0, None) for i in range(5)] + [(1, 9, 10.0, 900.0, 0.0, 18.0, 900.0, 0.0, None), (2, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, None)]
    out = C.stitch(spark.createDataFrame(rows, FRAG), "m", C.Gates(max_gap=6.0), F.lit(50.0), Scratch(spark, "t"))
    assert {(r.m, r.tid): r.track for r in out.collect()} == {**{(1, i): 0 for i in range(5)}, (1, 9): 9, (2, 0): 0}


def test_fragments_vote_their_kind(spark):
    rows = [(1, 5, 2.0, 1.0, 1.0, "red"), (1, 5, 1.0, 7.0, 3.0, "blue"), (1, 5, 3.0, 4.0, 4.0, "blue"), (1, 5, 4.0, 4.0, 6.0, "red"), (1, 6, 0.0, 0.0, 0.0, None)]
    f = C.fragments(spark.createDataFrame(rows, "m long, tid long, t double, x double, y double, kind string"), "m", "tid", "t", "x", "y", "kind")
    got = {r.tid: (r.t0, r.x0, r.t1, r.y1, r.kind) for r in f.collect()}
    assert got == {5: (1.0, 7.0, 4.0, 6.0, "blue"), 6: (0.0, 0.0, 0.0, 0.0, None)}


def test_strict_policy_wants_close_ends_and_the_same_hint(spark):
    seg = [(1, 1, 0.0, 1.0, 0.0, 0.0, "red"), (1, 2, 1.1, 2.0, 0.05, 0.1, "red"), (1, 3, 1.1, 2.0, 0.06, 0.1, "red"), (1, 4, 1.1, 2.0, 3.0, 3.1, "red")]
    hints = {1: "A", 2: "A", 3: "B", 4: "A"}
    other = spark.createDataFrame([(a, b) for a in hints for b in hints if hints[a] != hints[b]], "a long, b long")
    df = spark.createDataFrame(seg, "m long, seg long, t0 double, t1 double, x0 double, x1 double, kind string")
    out = J.successors(df, "m", 6.0, F.lit(50.0) + F.col("gap"), max_score=0.06, conflicts=other)
    assert [(r.a, r.b) for r in out.collect()] == [(1, 2)]


# -- naming -------------------------------------------------------------------
def case(rng, n, teams):
    scores = [[rng.randint(-20, 20) for _ in range(teams)] + [-rng.randint(0, 15)] for _ in range(n)]
    pairs = {(i, j): rng.choice((None, -30, -7, -3, 4, 9)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6}
    pins = {i: rng.randrange(teams) for i in range(n) if rng.random() < 0.15}
    return scores, pairs, pins


def every(scores, pairs, pins, teams, differ=None):
    n, best = len(scores), None
    for labels in product(range(teams + 1), repeat=n):
        if len(set(labels) - {teams}) < teams or any(labels[i] != k for i, k in pins.items()):
            continue
        if differ and any(k < teams for k in differ) and all(labels[i] == k for i, k in enumerate(differ) if k < teams):
            continue
        value = sum(scores[i][k] for i, k in enumerate(labels))
        for (i, j), w in pairs.items():
            if labels[i] == labels[j] < teams:
                both = i in pins and j in pins
                value = value + w if w is not None else value if both else -(10**9)
        if value > -(10**8) and (best is None or (-value, labels) < best):
            best = (-value, labels)
    return (None, None) if best is None else (-best[0], list(best[1]))


@pytest.mark.parametrize("budget", [3, 10**6])
def test_search_is_exact(budget):
    rng = random.Random(7)
    for n, teams in [(3, 2), (5, 3), (6, 3), (6, 2), (2, 3), (7, 2)] * 6:
        scores, pairs, pins = case(rng, n, teams)
        forbidden = [(i, j, N.NEVER if w is None else w) for (i, j), w in pairs.items() if not (w is None and i in pins and j in pins and pins[i] == pins[j])]
        want = every(scores, pairs, pins, teams)
        for differ in (None, want[1]):
            search, value, labels, left = N.Search(np.array(scores, np.int64), forbidden, pins, differ), None, None, [[]]
            while left:
                value, labels, more = search.run(left.pop(0), value, labels, budget)
                left += more
            assert (value, labels) == (every(scores, pairs, pins, teams, differ) if differ else want)


def test_bound_never_falls_short():
    rng = random.Random(9)
    for _ in range(40):
        scores, pairs, _ = case(rng, 5, 2)
        search = N.Search(np.array(scores, np.int64), [(i, j, N.NEVER if w is None else w) for (i, j), w in pairs.items()], {})
        free = max(sum(scores[i][k] for i, k in enumerate(ls)) + sum((-(10**9) if w is None else w) for (i, j), w in pairs.items() if ls[i] == ls[j] < 2) for ls in product(range(3), repeat=5))
        assert search.bound(0, search.scores) >= free


def test_naming_over_rounds(spark):
    """A budget of five nodes: open prefixes are dealt out over many rounds."""
    rng = random.Random(3)
    cases = {m: case(rng, rng.randint(3, 6), 3) for m in range(8)} | {99: ([[5, 5, 5, 0], [1, 1, 1, 0]], {}, {})}
    t = [(m, i, s[-1], pins.get(i)) for m, (scores, _, pins) in cases.items() for i, s in enumerate(scores)]
    s = [(m, i, k, v) for m, (scores, _, _) in cases.items() for i, row in enumerate(scores) for k, v in enumerate(row[:-1])]
    p = [(m, i, j, w) for m, (_, pairs, _) in cases.items() for (i, j), w in pairs.items()]
    found = N.problems(spark.createDataFrame(t, "m long, i int, park long, pin int"), spark.createDataFrame(s, "m long, i int, k int, score long"), spark.createDataFrame(p, "m long, i int, j int, weight long"), "m")
    first = N.solve(found, "m", 3, Scratch(spark, "t"), 5)
    def allowed(m):
        scores, pairs, pins = cases[m]
        return scores, {k: w for k, w in pairs.items() if not (w is None and k[0] in pins and k[1] in pins and pins[k[0]] == pins[k[1]])}, pins

    want = {m: every(*allowed(m), 3) for m in cases}
    got = {r.m: (r.value, r.labels) for r in first.collect()}
    assert got == want and got[99] == (None, None)
    out = {}
    for r in N.named(found, "m", 3, Scratch(spark, "t"), 5).collect():
        out.setdefault(r.m, {})[r.i] = r
    assert out.keys() == {m for m, w in want.items() if w[1]}
    for m, rows in out.items():
        value, labels = want[m]
        other = every(*allowed(m), 3, labels)
        assert [rows[i].label for i in sorted(rows)] == [None if k == 3 else k for k in labels]
        assert {r.gap for r in rows.values()} == {None if other[0] is None else value - other[0]}
        assert [rows[i].unstable for i in sorted(rows)] == [other[1] is not None and a != b for a, b in zip(labels, other[1] or labels, strict=True)]


def test_pair_costs(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 1, 2.0, 1.0, 0.0, 3.0, 1.0, 0.0), (1, 2, 1.5, 9.0, 0.0, 2.5, 9.0, 0.0), (1, 3, 40.0, 0.0, 0.0, 41.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "m long, i int, t0 double, x0 double, y0 double, t1 double, x1 double, y1 double")
    got = {(r.i, r.j): r.weight for r in N.pair_costs(df, "m").collect()}
    near, far = 3.33 + (4.58 - 3.33) * (1.0 - 0.88) / (1.25 - 0.88), 1.76 + (2.63 - 1.76) * (0.5 - 0.41) / (0.62 - 0.41)
    assert got == {(0, 1): -2, (0, 2): -(int(120 * min((9 - far) / far, 3)) + 1)} and near > 1


def test_rebinds_choose_by_looks(spark):
    """Two vanish at the tower; who comes out is told by its looks, if they differ enough."""
    left = lambda i, t: (1, i, t - 5.0, 0.0, 0.0, t, 95.0, 20.0, None)
    out_ = lambda i, t: (1, i, t, 105.0, 20.0, t + 3, 500.0, 300.0, None)
    looks = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.9, 0.1], 4: [0.7, 0.7], 5: [0.95, 0.05], 6: [-1.0, -1.0]}

    def rebound(rows):
        drawn = spark.createDataFrame(OUTLINES, "order int, structure string, poly array<array<double>>, closed boolean")
        v = spark.createDataFrame([(1, i, x) for i, x in looks.items()], "m long, tid long, v array<double>")
        got = C.rebinds(spark.createDataFrame(rows, FRAG), v, "m", C.Gates(max_gap=6.0, speed=50.0, edge=10.0), drawn, Scratch(spark, "t"))
        return {(r.keep, r.absorbed): (r.best, r.region, r.runner_up is None) for r in got.collect()}

    assert rebound([left(1, 10.0), left(2, 11.0), out_(3, 13.0)]) == {(1, 3): (1, "tower", False)}
    assert rebound([left(1, 10.0), left(2, 11.0), out_(4, 13.0)]) == {}  # as like one as the other
    assert rebound([left(1, 10.0), out_(6, 13.0)]) == {}  # like none
    assert rebound([left(1, 10.0), out_(7, 13.0)]) == {}  # no looks
    # 3 was absorbed by 1, so 5 is a continuation of 1 too, though 3 ends there last
    again = (1, 3, 13.0, 105.0, 20.0, 16.0, 95.0, 20.0, None)
    assert rebound([left(1, 10.0), again, out_(5, 17.0)]) == {(1, 3): (1, "tower", True), (1, 5): (1, "tower", True)}
