"""Steps whose memory, disk or time must not outgrow their input."""

from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest

from trackloom.functions import scalars as S
from trackloom.operators import assignment as G
from trackloom.operators import joins as J
from trackloom.operators import selection as O
from trackloom.operators import upserts as U
from trackloom.operators import windows as W
from trackloom.streaming import ledger as T


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [32, 4096])
def test_pairs_are_counted_in_tiles(spark, block):
    rng = np.random.default_rng(1)
    rows = [(int(g), str(h), int(i)) for g, h, i in zip(rng.integers(0, 6, 900), rng.integers(0, 2, 900), rng.integers(0, 200, 900), strict=True)]
    df = spark.createDataFrame([*rows, (None, "0", 1), (None, "0", 2), (1, None, 3), (1, "1", None)], "g long, h string, i long")
    out = J.co_occurring(df, ["g", "h"], "i", block)
    assert "Join" not in plan(out)  # no pair is shuffled
    seen: dict = {}
    for g, h, i in rows:
        seen.setdefault((g, h), set()).add(i)
    want = Counter(p for s in seen.values() for p in combinations(sorted(s), 2))
    got = out.collect()
    assert {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want)


def test_pairs_of_nothing(spark):
    assert J.co_occurring(spark.createDataFrame([], "g long, i string"), ["g"], "i").count() == 0


def test_nearest_on_a_line_makes_no_pairs(spark):
    rng = np.random.default_rng(2)
    left = [(k, int(g), float(v)) for k, (g, v) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 400, 300) / 2, strict=True))]
    right = [(k, int(g), float(v)) for k, (g, v) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 400, 60) / 2, strict=True))]
    left += [(1000, 7, 1e9), (1001, 8, 1.0), (1002, None, 1.0), (1003, 7, None), (1004, 7, float("nan")), (1005, 9, 30.0)]
    right += [(1000, 7, 1.0), (1001, 7, None), (1002, 7, float("nan")), (1003, None, 1.0)]
    right += [(1007, 9, 1e-17), (1006, 9, 2e-17), (1005, 9, 0.0)]  # three places, one distance from 30
    one, two = spark.createDataFrame(left, "lid long, g long, lv double"), spark.createDataFrame(right, "rid long, g long, rv double")
    want = {}
    for lid, g, v in left:
        near = [(abs(v - w), rid) for rid, h, w in right if v is not None and w is not None and g == h and g is not None and abs(v - w) <= 10 + 20 * (g == 9)]
        want[lid] = min(near, default=(None, None))
    out = J.nearest_on_line(one.where("g < 9 or g is null"), two.where("g < 9 or g is null"), "g", "lid", "lv", "rv", "rid", 10.0)
    out = out.union(J.nearest_on_line(one.where("g = 9"), two.where("g = 9"), "g", "lid", "lv", "rv", "rid", 30.0)).collect()
    assert {r.lid: (r.distance, r.rid) for r in out} == want and len(out) == len(left)


def test_nearest_in_group_passes_over_missing_places(spark):
    left, right = spark.createDataFrame([(1, 0, 5.0)], "lid long, g long, lv double"), spark.createDataFrame([(1, 0, None), (2, 0, 6.0), (3, 0, 4.0)], "rid long, g long, rv double")
    d = (J.F.col("lv") - J.F.col("rv")) ** 2
    out = J.nearest_in_group(left, right, ["g"], "lid", d, ["rid"], 40.0, ["rid"]).first()
    assert (out.rid, out.distance) == (2, 1.0)


def test_stretches_are_smoothed_together(spark):
    rng = np.random.default_rng(3)
    size = [1, 40, 3, 7, 2, 40, 25]
    t = np.concatenate([np.cumsum(rng.uniform(0.02, 0.4, n)) for n in size])
    z = rng.normal(size=(len(t), 2))
    at = np.cumsum([0, *size[:-1]])
    x, var = W.smooth_stretches(t, z, at)
    for i, n in zip(at, size, strict=True):
        assert all(np.allclose(a, b) for a, b in zip(W.smooth_stretch(t[i : i + n], z[i : i + n]), (x[i : i + n], var[i : i + n]), strict=True))
    rows = [(k, float(a), float(b), float(c)) for k, (i, n) in enumerate(zip(at, size, strict=True)) for a, (b, c) in zip(t[i : i + n], z[i : i + n] / 50, strict=True)]
    df = spark.createDataFrame([*rows, (9, None, 1.0, 1.0), (9, 1.0, None, 2.0)], "tid long, t double, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # stretches go on over batches
    try:
        out = W.smooth_tracks(df, ["tid"], gap=0.45, mult=100.0)
        assert "InPandas" not in plan(out)  # no Python call per stretch
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) + 2
    assert sorted((r.t, r.x, r.y, r.sd) for r in got if r.tid == 9 and r.t) == [(1.0, None, 2.0, 0.1)]
    for k, (i, n) in enumerate(zip(at, size, strict=True)):
        mine = sorted((r.t, r.x, r.y, r.sd) for r in got if r.tid == k)
        xs, vs = W.smooth_stretch(t[i : i + n], z[i : i + n] / 50) if n >= 3 else (z[i : i + n] / 50, np.full(n, 0.01))
        assert np.allclose(mine, np.column_stack((t[i : i + n], xs, np.sqrt(vs))))


def test_ledger_by_tables(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sink = T.ledger_sink(spark, path, delay_ms=1000, keep_ms=60_000)
    day = lambda s: f"2024-01-01 {s}"
    slices = [
        [("j1", "00:00:03", "failed", "c"), ("j1", "00:00:01", "started", None), ("j1", "00:00:02", "failed", "b"), ("j2", "00:00:01", "failed", "x"), ("j2", "00:00:02", "progressed", None), ("j3", "00:00:01", "done", None), ("j3", "00:00:02", "failed", "late"), ("j5", "00:00:01", "superseded", None)],
        [("j1", "00:00:04", "failed", "d"), ("j1", "00:00:05", "started", None), ("j2", "00:00:01", "failed", "too late"), ("j5", "00:00:09", "started", None), (None, "00:00:09", "started", None)],
        [("j4", "02:00:00", "started", None), (None, "02:00:00", "failed", "n")],
        [("j3", "02:00:01", "started", None), ("j6", "02:00:02", "requested", None)],
    ]
    for n, rows in enumerate(slices):
        batch = spark.createDataFrame([(j, day(at), e, r) for j, at, e, r in rows], "job string, at string, event string, reason string").withColumn("at", J.F.to_timestamp("at"))
        for _ in range(2):  # a batch may run again
            sink(batch.union(batch.limit(1).withColumns({"job": J.F.lit("j9"), "at": J.F.lit(None).cast("timestamp")})), n)
    changes = spark.read.schema(f"{T.JOBS}, batch int").parquet(f"{path}/changes")
    got = {(r.batch, r.job): (r.state, r.attempts, r.reason) for r in changes.collect()}
    assert got == {
        (0, "j1"): ("failed", 2, "c"), (0, "j2"): ("failed", 0, None), (0, "j3"): ("done", 0, None), (0, "j5"): ("superseded", 0, None),
        (1, "j1"): ("benched", 3, "d"), (1, "j5"): ("running", 0, None), (1, None): ("running", 0, None),
        (2, "j4"): ("running", 0, None), (2, None): ("failed", 1, "n"), (3, "j3"): ("running", 0, None), (3, "j6"): ("queued", 0, None),
    }
    # ended jobs go once the watermark has passed them; open ones stay
    assert {r.job for r in spark.read.parquet(f"{path}/state/batch=3").collect()} == {"j2", "j3", "j4", "j5", "j6", None}


def test_matches_are_coloured_a_few_at_a_time(spark):
    assert 0 < G._MATCHES <= 64  # matches that are Python objects at once
    n = 2 * G._MATCHES + 3
    t = spark.createDataFrame([(m, 10 * m + k, float(k), 0.0, 0.0, k + 5.0, 0.0, 0.0, 1, None) for m in range(n) for k in range(3)], "m long, tid long, t0 double, x0 double, y0 double, t1 double, x1 double, y1 double, n long, side string").coalesce(1)
    p = spark.createDataFrame([(m, 10 * m, 10 * m + 1) for m in range(0, n, 2)], "m long, a long, b long")
    v = spark.createDataFrame([], "m long, tid long, team string, n long")
    got = {r.tid: r.g for r in G.colour_tracks(t, p, v, "m", 2).collect()}
    assert len(got) == 3 * n and {m: (got[10 * m], got[10 * m + 1]) for m in range(n)} == {m: (0, 1 - m % 2) for m in range(n)}


def test_marked_keys_are_merged_not_broadcast(spark):
    labels, bundle = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string"), spark.createDataFrame([(1,), (1,), (3,), (None,)], "k long")
    out = U.marked(labels, bundle, ["k"], "gone")
    assert "Broadcast" not in plan(out) and "SortMergeJoin" in plan(out)
    assert sorted((r.v, r.gone) for r in out.collect()) == [("a", True), ("b", True), ("c", False), ("d", False)]
    kept, gone = U.retire_rounds(labels, bundle, ["k"])
    assert (sorted(r.v for r in kept.collect()), sorted(r.v for r in gone.collect())) == (["c", "d"], ["a", "b"]) and kept.columns == ["k", "v"]


def test_sides_are_balanced_with_one_sort(spark):
    d = spark.createDataFrame([(m, "red" if (k + m) % 6 < 4 else "blue", k / 10) for m in range(4) for k in range(6)], "m int, side string, c double")
    out = O.balance_sides(d, ["m"], "side", "c", "red", "blue")
    assert plan(out).count("Sort ") == 1
    got = out.where("balanced != side").collect()
    want = {(m, min(k / 10 for k in range(6) if (k + m) % 6 < 4)) for m in range(4)}
    assert {(r.m, r.c) for r in got} == want and len(got) == 4


def test_undistorted_is_compiled(spark):
    lens = {"f": 1000.0, "k1": -0.1, "k2": 0.01, "cx": 960.0, "cy": 540.0}
    d = spark.createDataFrame([(1200.0, 700.0), (960.0, 540.0), (0.0, 1080.0), (None, 1.0)], "x double, y double")
    dx, dy = S.distort("x", "y", **lens)
    d = d.select("x", "y", dx.alias("dx"), dy.alias("dy"))
    out = S.undistorted(d, "dx", "dy", ("bx", "by"), **lens)
    assert out.columns == [*d.columns, "bx", "by"] and "lambda" not in plan(out)
    u, v = S.undistort("dx", "dy", **lens)
    for r in out.withColumns({"u": u, "v": v}).collect():
        assert (r.bx, r.by) == (r.u, r.v)


def test_groups_are_named_without_shuffles_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(int(m), int(g), f"T{k}", s) for m, g, k, s in zip(rng.integers(0, 30, 300), rng.integers(0, 3, 300), rng.integers(0, 3, 300), rng.choice(["red", "blue"], 300), strict=True)]
    lines = spark.createDataFrame(rows, "m long, g int, team string, s string").repartition(3, "m")
    groups = lines.groupBy("m", "g").agg(J.F.when(J.F.count("*") > 2, J.F.min("s")).alias("side"))
    votes = lines.where("g != 1 or m % 2 = 0").groupBy("m", "g", "team").agg(J.F.count("*").alias("n"))
    teams = lines.select("m").distinct().select("m", J.F.explode(J.F.array(*map(J.F.lit, range(3)))).alias("k")).select("m", "k", J.F.concat(J.F.lit("T"), "k").alias("team"), J.F.when(J.F.col("k") == 1, "blue").otherwise("red").alias("side"))
    out = G.name_groups(groups, votes, teams, "m", 3)
    assert plan(out).count("Exchange ") == 3  # the three readings of lines
    tally, side = Counter((r.m, r.g, r.team) for r in votes.collect() for _ in range(r.n)), {(r.m, r.g): r.side for r in groups.collect()}

    def cost(m, g, k):
        if (m, g) not in side:
            return 50.0
        total = sum(tally[m, g, f"T{t}"] for t in range(3))
        off = side[m, g] is not None and side[m, g] != ("blue" if k == 1 else "red")
        return 50.0 - (tally[m, g, f"T{k}"] * 100.0 / total if total else 0.0) + (500.0 if off else 0.0)

    want = {}
    for m in {m for m, _ in side}:
        c, p = min((round(sum(cost(m, g, p[g]) for g in range(3)), 9), p) for p in permutations(range(3)))
        want |= {(m, g): (f"T{p[g]}", c) for g in range(3) if (m, g) in side}
    got = out.collect()
    assert {(r.m, r.g): (r.team, r.cost) for r in got} == want and len(got) == len(want)
