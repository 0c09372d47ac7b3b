"""Rows judged by the accepted ones before them, one by one."""

import random

import numpy as np
import pytest

from trackloom.operators import folds as K


def one_by_one(rows, window, least):
    out = {}
    for key in {r[1] for r in rows}:
        past = []
        for i, _, t, h, b in sorted((r for r in rows if r[1] == key and None not in r[2:]), key=lambda r: (r[2], r[0])):
            near = [p for p in past if t - window <= p[0] < t]
            tall, low = (np.median([p[k] for p in near]) if near else 0 for k in (1, 2))
            out[i] = not (len(near) >= least and h < 0.7 * tall and low - b > 0.25 * tall)
            if out[i]:
                past.append((t, h, b))
    return {r[0]: out.get(r[0], True) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_partial_boxes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        part = rng.random() < 0.3
        rows.append((i, rng.choice("abc"), round(rng.uniform(0, 60), 1), 40.0 * part + 100 * (not part) + rng.random(), (250.0 if part and rng.random() < 0.8 else 300.0) + rng.random()))
    rows += [(900, "a", 5.0, None, 250.0), (901, "a", None, 40.0, 250.0), (902, "z", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i long, k string, t double, h double, b double").repartition(3)
    got = {r.i: r.whole for r in K.whole_boxes(df, ["k"], "t", ["i"], "h", "b").collect()}
    want = one_by_one(rows, 1.5, 5)
    assert got == want and 20 < sum(not w for w in want.values()) < 200


def test_no_rows_and_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 1.0, 2.0, "x")], "i long, k string, t double, h double, b double, more string")
    out = K.whole_boxes(df, ["k"], "t", ["i"], "h", "b")
    assert out.columns == [*df.columns, "whole"] and [tuple(r) for r in out.collect()] == [(1, "a", 0.0, 1.0, 2.0, "x", True)]
    assert K.whole_boxes(df.where("i > 5"), ["k"], "t", ["i"], "h", "b").collect() == []
