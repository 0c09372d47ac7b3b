"""Scatter matrices and whitening heads against NumPy over the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import appearance as M
from trackloom.operators import heads as H
from trackloom.plans.runtime import Scratch


def made(spark, v, labels):
    rows = [(None if k < 0 else int(k), [float(y) for y in x]) for k, x in zip(labels, v, strict=True)] + [(3, None)]
    return spark.createDataFrame(rows, "label long, v array<double>").repartition(5)


def test_scatter_of_labels_large_and_small(spark):
    rng = np.random.default_rng(1)
    labels = np.concatenate((np.repeat(np.arange(6), 20), [50, 51, 51, -1, -1]))
    v = rng.normal(size=(len(labels), 5)) + 1000  # far from the origin
    cells, mean, n, free = H.scatter(made(spark, v, labels), "label", "v", Scratch(spark, "t"))
    known = labels >= 0
    x = v[known] - v[known].mean(axis=0)
    within = sum((v[labels == k] - v[labels == k].mean(0)).T @ (v[labels == k] - v[labels == k].mean(0)) for k in [*range(6), 51])
    got = {(r.i, r.j): (r.total, r.within) for r in cells.collect()}
    assert mean == pytest.approx(v[known].mean(axis=0)) and (n, free) == (123, 6 * 19 + 1) and len(got) == 25
    for (i, j), (t, w) in got.items():
        assert t == pytest.approx((x.T @ x)[i, j], abs=1e-6) and w == pytest.approx(within[i, j], abs=1e-6)


def test_head_whitens_within_labels(spark):
    rng = np.random.default_rng(0)
    labels = np.repeat(np.arange(10), 30)
    v = rng.normal(size=(10, 8))[labels] * 3 + rng.normal(size=(300, 8)) * np.linspace(0.2, 3, 8)
    df = made(spark, v, labels)
    mean, m = H.fit_head(df, "label", "v", Scratch(spark, "t"), ridge=1e-6)
    z = (v - mean) @ m
    within = sum((z[labels == g] - z[labels == g].mean(0)).T @ (z[labels == g] - z[labels == g].mean(0)) for g in range(10)) / 290
    assert np.allclose(within, np.eye(8), atol=1e-2)
    applied = M.apply_head(df.where("v is not null").select("v"), "v", mean, m).select(F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))
    assert sorted(r.s for r in applied.collect()) == pytest.approx(sorted(z.sum(axis=1)), abs=2e-6)


def test_head_of_fewer_directions(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 6))
    mean, m = H.fit_head(made(spark, v, np.arange(40) % 4), "label", "v", Scratch(spark, "t"))
    assert m.shape == (6, 3) and np.isfinite(m).all()
    assert H.fit_head(made(spark, v, np.arange(40) % 4), "label", "v", Scratch(spark, "t"), dims=2)[1].shape == (6, 2)
    with pytest.raises(ValueError, match="no labelled"):
        H.fit_head(made(spark, v, np.full(40, -1)).where("label is null"), "label", "v", Scratch(spark, "t"))
