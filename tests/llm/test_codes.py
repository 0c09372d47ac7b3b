"""Vector codes against k-means in Python's whole numbers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from trackloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, dim int, id long"


def brute(rows, entries=16, rounds=6):
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for dim in {len(v) for _, v, _ in kept}:
        mine = [(i, [math.floor(Fraction(x) * 4096) for x in v], lab, v) for i, v, lab in kept if len(v) == dim]
        starts = {}
        for i, x, _, v in mine:
            key = (i is None, i or 0)
            starts[key] = min(starts.get(key, (v, x)), (v, x))
        first = [starts[k][1] for k in sorted(starts)][:entries]
        cut = [(k * dim // 8, (k + 1) * dim // 8) for k in range(8)]
        books = [[x[a:b] for x in first] for a, b in cut]

        def near(x, book):
            return min((sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), e) for e, y in enumerate(book))

        for _ in range(rounds):
            for k, (a, b) in enumerate(cut):
                groups = {}
                for _, x, _, _ in mine:
                    groups.setdefault(near(x[a:b], books[k])[1], []).append(x[a:b])
                books[k] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else y for e, y in enumerate(books[k])]
        sha = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
        for i, x, lab, _ in mine:
            found = [near(x[a:b], books[k]) for k, (a, b) in enumerate(cut)]
            out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab, sha])
    total = {}
    for r in out:
        total[r[3]] = total.get(r[3], 0) + r[2]
    most = (1 << 63) - 1
    return sorted(((r[0], r[1], min(r[2], most), min(total[r[3]], most), r[4]) for r in out), key=str)


def coded(spark, rows):
    docs = spark.createDataFrame([(i, v, lab, "c", "e", 1, 2) for i, v, lab in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(docs).collect()), key=str)


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(n)]


def test_codes(spark):
    rows = [(3 * i, v, (None, 1, 2)[i % 3]) for i, v in enumerate(vectors(150, 16, 1))]
    rows += [(1, None, 1), (2, [math.nan] * 16, 1), (4, [None] * 16, None), (5, [math.inf] * 16, 1), (7, [0.0] * 16, 5), (10_001, [0.0] * 16, 5)]
    rows += [rows[0], rows[0], (0, [0.25] * 16, 1), (None, rows[3][1], 1), (None, [0.5] * 16, 1)]
    assert coded(spark, rows) == brute(rows)


def test_ties_and_few_values(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((0.0, 0.5, -0.5, 1 / 4096)) for _ in range(8)], i % 2) for i in range(120)]
    assert coded(spark, rows) == brute(rows)


def test_lengths(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(40, 11, 5))] + [(100 + i, v, 0) for i, v in enumerate(vectors(9, 3, 6))] + [(200, [], 0), (201, [], None)]
    assert coded(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [2.0**20, 2.0**40])
def test_wide_components(spark, size):
    rows = [(i, v, 0) for i, v in enumerate(vectors(40, 8, 7))] + [(50 + i, v, 1) for i, v in enumerate(vectors(30, 8, 8, size))]
    assert coded(spark, rows) == brute(rows)


def test_all_null_ids_and_empty_table(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []
    rows = [(None, v, None) for v in vectors(5, 8, 9)]
    assert coded(spark, rows) == brute(rows)


def test_bounds_hold(spark):
    """Filtering keeps the nearest entry and leaves few to compare."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 16, 40):
        entries, q = rng.integers(-900, 900, (n, 8)), rng.integers(-900, 900, (500, 8))
        near, error = vector_codes.Cells(entries).nearest(q)
        d = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (d.argmin(axis=1) == near).all() and (d.min(axis=1) == error).all()
