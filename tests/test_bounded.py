"""What one task holds of a gallery doesn't grow with it."""

import numpy as np

from trackloom.operators import appearance as M
from trackloom.operators import gallery_index
from trackloom.plans.runtime import BATCH_ROWS, Scratch


def _vectors(spark, n):
    v = np.random.default_rng(3).normal(size=(n, 8)).tolist()
    return spark.createDataFrame([(i, i % 3, x) for i, x in enumerate(v)], "qid long, label long, vector array<double>")


def test_few_pairs_of_blocks_at_a_time(spark, monkeypatch):
    seen, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a, **k: (seen.append((name, k.get("batch_rows"))), keep(self, df, name, *a, **k))[1])
    d = _vectors(spark, 200)
    before = spark.conf.get(BATCH_ROWS)
    got = gallery_index.votes(d.select("qid", "vector"), d.select("label", "vector"), Scratch(spark, "t"))
    assert {n: b for n, b in seen if n in ("first", "second")} == {"first": gallery_index.PAIRS, "second": gallery_index.PAIRS}
    assert spark.conf.get(BATCH_ROWS) == before and got.count() == 200


def test_few_similarities_at_a_time(spark, monkeypatch):
    d = _vectors(spark, 200)
    q, p = d.select("qid", "vector"), d.select("label", "vector")
    want = {tuple(r) for r in M.prototype_votes(q, p).collect()}
    monkeypatch.setattr(M, "SIMILARITIES", 1_000)
    assert {tuple(r) for r in M.prototype_votes(q, p).collect()} == want and len(want) == 200
