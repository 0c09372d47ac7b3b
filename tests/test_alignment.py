"""Snippets placed in clips, against sliding them along."""

import numpy as np

from trackloom.operators import alignment as L


def slid(local, snip, apart):
    c, s = (x - x.mean(axis=1, keepdims=True) for x in (local, snip))
    scores = []
    for k in range(len(c) - len(s) + 1):
        w = c[k : k + len(s)]
        scale = np.sqrt((w * w).sum() * (s * s).sum())
        scores.append(round(float((w * s).sum() / scale), 9) if scale else 0.0)
    if not scores:
        return None
    k = int(np.argmax(scores))
    far = [x for i, x in enumerate(scores) if abs(i - k) > apart]
    return k, scores[k], max(far, default=0.0)


def test_located(spark):
    rng = np.random.default_rng(3)
    clips = {i: rng.normal(size=(n, 5)) for i, n in enumerate((60, 40, 12, 8))}
    clips[4] = np.tile(rng.normal(size=(10, 5)), (3, 1))  # the same three times over
    snips = {(i, 10 * i): clips[i][3:15] * 2 + 1 for i in range(3)} | {(0, 1): rng.normal(size=(12, 5)), (3, 31): clips[3], (3, 32): rng.normal(size=(11, 5)), (4, 40): clips[4][:10], (1, 15): np.ones((11, 5))}
    c = spark.createDataFrame([(i, k, [float(x) for x in v]) for i, m in clips.items() for k, v in enumerate(m)], "clip long, i long, v array<double>").repartition(3)
    s = spark.createDataFrame([(i, j, k, [float(x) for x in v]) for (i, j), m in snips.items() for k, v in enumerate(m)], "clip long, snippet long, i long, v array<double>")
    got = {(r.clip, r.snippet): (r.offset, r.score, r.runner_up, r.found) for r in L.located(c, s, 2, 0.5, 0.1).collect()}
    want = {k: slid(clips[k[0]], m, 2) for k, m in snips.items() if len(m) >= 10}
    want = {k: w for k, w in want.items() if w}
    assert got.keys() == want.keys() and (3, 31) not in got and (3, 32) not in got
    for k, (at, score, second) in want.items():
        assert got[k][0] == at and abs(got[k][1] - score) < 1e-8 and abs(got[k][2] - second) < 1e-8
        assert got[k][3] == (score >= 0.5 and score - second >= 0.1)
    assert got[0, 0][:2] == (3, 1.0) and got[0, 0][3] and not got[4, 40][3] and got[1, 15][:2] == (0, 0.0)
    leads = spark.createDataFrame([(0, "b", 100.0, 0.5, 1), (10, "c", 50.0, 0.5, 0), (40, "d", 1.0, 0.5, 0)], "snippet long, source string, t double, seconds double, rank int")
    found = L.located(c, s, 2, 0.5, 0.1)
    assert {r.clip: (r.source, r.start) for r in L.sources(found, leads).collect()} == {0: ("b", 98.5), 1: ("c", 48.5)}
