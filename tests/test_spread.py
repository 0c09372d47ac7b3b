"""Joins whose rows grow on the way: no side may be sent through the driver."""

from trackloom.operators import graph
from trackloom.operators import joins as J
from trackloom.plans.runtime import Scratch


def test_windows_are_no_broadcast(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).selectExpr("id % 7 AS k", "id AS a", "double(id) AS a_t").write.parquet(path)
    t = spark.read.parquet(path)
    j = J.within_window(t, t.toDF("k", "b", "b_t"), ["k"], "a_t", "b_t", 3.0)
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    assert j.count() == sum(1 for a in range(1000) for b in range(a - 3, a + 4) if 0 <= b < 1000 and a % 7 == b % 7)


def test_only_conflicts_are_grouped(spark):
    rows = [(0, i % 40, float(i), float(i % 3) * 300, 0.0) for i in range(400)]
    d = spark.createDataFrame(rows, "m long, i long, t double, x double, y double")
    j = J.kinematic_conflicts(d, "m", "i", "t", "x", "y", 5.0, J.F.lit(400.0))
    plan = j._jdf.queryExecution().optimizedPlan().toString()
    assert "bool_or" not in plan and "HYPOT" in plan.upper()
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[1] != b[1] and abs(a[2] - b[2]) <= 5 and abs(a[3] - b[3]) > 400}
    assert {(r.a, r.b) for r in j.collect()} == want and want


def test_components_without_broadcast(spark, monkeypatch):
    plans = []
    keep = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df, *a))[1])
    edges = spark.range(50).selectExpr("id AS src", "id + 1 AS dst")
    assert {tuple(r) for r in graph.connected_components(edges, Scratch(spark, "t")).collect()} == {(i, 0) for i in range(51)}
    chain = spark.range(1, 50).selectExpr("id AS src", "id - 1 AS dst")
    assert {tuple(r) for r in graph.collapse_chains(chain, Scratch(spark, "t")).collect()} == {(i, 0) for i in range(1, 50)}
    assert not [p for p in plans if "Broadcast" in p]
