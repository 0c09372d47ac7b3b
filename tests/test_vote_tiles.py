"""Votes of a large gallery without structure: all pairs, in tiles, and no visit a row."""

import numpy as np
import pytest
from test_votes import brute, same, tables, voted

from trackloom.operators import gallery_index as I
from trackloom.operators import gallery_tiles as T
from trackloom.plans.runtime import Scratch


@pytest.fixture
def asked(monkeypatch):
    """Every gallery is large, and every block small."""
    for where, name, value in ((I, "ASKED", 0), (I, "SAMPLE", 9), (T, "BLOCK", 60), (T, "LEAST", 40)):
        monkeypatch.setattr(where, name, value)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tiles_equal_all_pairs(spark, asked, monkeypatch, kind):
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a, **k: (kept.append(name), keep(self, df, name, *a, **k))[1])
    rng = np.random.default_rng(4)
    p, q, labels = rng.normal(size=(130, 6)), rng.normal(size=(90, 6)), rng.integers(0, 4, 130)
    labels[7], labels[11:13] = 8, 9  # labels of one vector, and of two
    q[0], q[1], p[3], q[5] = p[7], 0, 0, -p[7]
    p[20:24] = p[20]  # ties
    labels = labels if kind == "long" else np.array([f"x{i}" for i in labels])
    same(voted(spark, q, p, labels, kind), brute(range(90), q, p, labels))
    assert "tiles" in kept and "second" not in kept


def test_tiles_of_small_labels_and_of_one(spark, asked):
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(130, 5)), rng.normal(size=(50, 5))
    for labels in (np.arange(130) // 2, np.array([5] * 130)):  # many inside a tile; one over several
        same(voted(spark, q, p, labels), brute(range(50), q, p, labels))


def test_structure_is_still_used(spark, asked, monkeypatch):
    monkeypatch.setattr(I, "SHARE", 0.2)
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a, **k: (kept.append(name), keep(self, df, name, *a, **k))[1])
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16))
    p, labels = np.repeat(centre, 6, axis=0) + rng.normal(size=(240, 16)) * 0.02, np.repeat(np.arange(40) % 10, 6)
    got = voted(spark, centre + 0.02, p, labels, groups=80, margin=False)
    same(got, {k: (*w[:2], None) for k, w in brute(range(40), centre + 0.02, p, labels).items()})
    assert "second" in kept and "tiles" not in kept


def test_best_of_rows_under_maxima():
    rng = np.random.default_rng(8)
    for m, k in ((5, 3), (200, 3), (211, 1), (512, 4)):
        sim = np.round(rng.normal(size=(m, 7)), 1)  # with ties
        best = np.full((k, 7), -np.inf)
        for part in np.array_split(sim, 3) if m > 5 else [sim]:
            T.raise_best(best, part.copy())
        assert (best == -np.sort(-sim, axis=0)[:k]).all()


def test_margin_is_rounded_once(spark):
    x = np.array([0.3000015, 0.1])  # 0.2000015 apart, a little less as doubles
    queries, gallery = tables(spark, [[1.0, 0.0]], np.stack((x, np.sqrt(1 - x * x)), axis=1), [1, 2])
    assert [r.margin for r in I.votes(queries, gallery, Scratch(spark, "t")).collect()] == [0.3000015 - 0.1]
