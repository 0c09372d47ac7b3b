"""Spans of a trusted view against a state carried from sample to sample."""

import random

import pytest

from trackloom.operators import validity as V

KINDS = ("ok", "moved", "blank", "cut", None)


def one_by_one(rows, hold=2, sample=2.0):
    """The state after every sample, then spans of good states."""
    if not rows:
        return []
    need = {"blank": round(6.0 / sample), "cut": round(4.0 / sample)}
    said = [(t, v) for t, v in rows if v]
    row, state, marks = 0, "ok", [("ok", rows[0][0])]
    for i, (t, v) in enumerate(said):
        row = row + 1 if i and said[i - 1][1] == v else 1
        new = "ok" if v == "ok" else "bad"
        if row >= max(1, need.get(v, hold)) and new != state:
            state = new
            marks.append((state, said[i - row + 1][0]))
    spans = []
    for (kind, lo), stop in zip(marks, [*(t for _, t in marks[1:]), None], strict=True):
        if kind == "ok":
            good = [t for t, v in said if v == "ok" and stop is not None and t < stop]
            spans.append((lo, rows[-1][0] if stop is None else max([lo, *good])))
    return [(a, b) for a, b in spans if b > a and b - a >= sample]


def spans(spark, logs, **more):
    rows = [(k, float(t), v) for k, log in logs.items() for t, v in log]
    df = spark.createDataFrame(rows, "k long, t double, verdict string").repartition(3)
    out = {}
    for r in V.valid_spans(df, "k", "t", "verdict", **more).collect():
        out.setdefault(r.k, []).append((r.lo, r.hi))
    return {k: sorted(out.get(k, [])) for k in logs}


@pytest.mark.parametrize("bucket", [4.0, 30.0, 10_000.0])
def test_spans_as_one_by_one(spark, bucket):
    rng = random.Random(bucket)
    logs = {}
    for k in range(40):
        log, t = [], rng.uniform(0, 50)
        while len(log) < rng.randint(1, 60):
            v = rng.choice(KINDS)
            for _ in range(rng.randint(1, 5)):
                log.append((t, v))
                t += 2.0
        logs[k] = log
    assert spans(spark, logs, bucket=bucket) == {k: one_by_one(log) for k, log in logs.items()}


def test_spans_of_known_logs(spark):
    ok, mv = "ok", "moved"
    assert spans(spark, {1: list(enumerate([ok, ok, mv, ok, mv, mv, ok, ok]))}, sample=1.0) == {1: [(0, 3), (6, 7)]}
    logs = {1: list(zip([0, 2, 4, 6, 8], ["ok", "blank", None, "blank", "ok"], strict=True)), 2: list(zip([0, 2, 4, 6, 8], ["ok", "cut", None, "cut", None], strict=True)), 3: [(0, None)], 4: [(0, None), (2, None), (4, None)]}
    assert spans(spark, logs) == {1: [(0, 8)], 2: [], 3: [], 4: [(0, 4)]}
