"""Votes of a whole gallery, by matrix and by index, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import appearance as M
from trackloom.operators import gallery_index as I
from trackloom.plans import catalog
from trackloom.plans.runtime import Scratch


def brute(ids, q, p, labels):
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim, out = np.round(unit(np.array(q, float)) @ unit(np.array(p, float)).T, 9), {}
    for i, name in enumerate(ids):
        score = {k: round(float(np.sort(sim[i, labels == k])[-3:].mean()), 9) for k in np.unique(labels).tolist()}
        order = sorted(score, key=lambda k: (-score[k], k))
        out[name] = order[0], round(score[order[0]], 6), round(score[order[0]] - score[order[1]], 6) if len(order) > 1 else None
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, (label, score, margin) in want.items():
        assert got[k][0] == label and abs(got[k][1] - score) < 2e-6 and (margin is None) == (got[k][2] is None) and (margin is None or abs(got[k][2] - margin) < 2e-6)


def tables(spark, q, p, labels, kind="long"):
    queries = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(q)], "qid long, vector array<double>").repartition(3)
    gallery = spark.createDataFrame([(int(k) if kind == "long" else k, [float(y) for y in x]) for k, x in zip(labels, p, strict=True)], f"label {kind}, vector array<double>").repartition(2)
    return queries, gallery


def voted(spark, q, p, labels, kind="long", **more):
    found = I.votes(*tables(spark, q, p, labels, kind), Scratch(spark, "t"), **more)
    return {r.qid: (r.label, r.score, r.margin) for r in found.collect()}


def test_all_labelled_vectors_vote(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    v = [r.embedding for r in rows]
    want = brute([r.vec_id for r in rows], v, v, np.array([r.label for r in rows]))
    same({r.qid: (r.label, r.score, r.margin) for r in catalog.QUERIES["cosine_topk_vote_all"](spark, sf).collect()}, want)
    got = {r.qid: (r.label, r.score) for r in catalog.QUERIES["cosine_topk_vote"](spark, sf).collect()}
    assert all(got[k][0] == w[0] and abs(got[k][1] - w[1]) < 2e-6 for k, w in want.items())


@pytest.mark.parametrize(("groups", "rows"), [(1, 5), (9, 1000), (60, 3)])
def test_index_equals_all_pairs(spark, groups, rows):
    rng = np.random.default_rng(groups)
    p, labels, q = rng.normal(size=(90, 6)), rng.integers(0, 4, 90), rng.normal(size=(40, 6))
    labels[7] = 9  # a label with one vector can win
    q[0], q[1], p[3], q[5] = p[7], 0, 0, -p[7]
    p[20:24] = p[20]  # ties
    same(voted(spark, q, p, labels, groups=groups, rows=rows), brute(range(40), q, p, labels))


def test_index_of_text_labels_and_of_one_label(spark):
    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(30, 4)), rng.normal(size=(8, 4))
    same(voted(spark, q, p, np.array(["b", "a", "c"] * 10), "string"), brute(range(8), q, p, np.array(["b", "a", "c"] * 10)))
    same(voted(spark, q, p, np.array([5] * 30)), brute(range(8), q, p, np.array([5] * 30)))
    queries, gallery = tables(spark, q, p, [1] * 30)
    assert I.votes(queries, gallery.where("label = 0"), Scratch(spark, "t")).collect() == []
    assert I.votes(queries.where("qid < 0"), gallery, Scratch(spark, "t")).collect() == []


def test_structure_is_used_and_settings_stay(spark):
    """Vectors in tight groups: a query visits few of them, and four times the gallery
    in four times the groups is hardly more work a query."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    work = []
    for n in (25, 100):
        rng = np.random.default_rng(n)
        centre = rng.normal(size=(n, 16))
        p = np.repeat(centre, 12, axis=0) + rng.normal(size=(12 * n, 16)) * 0.02
        labels, q = np.repeat(np.arange(n) % 10, 12), centre[:25] + 0.02
        scratch = Scratch(spark, "t")
        queries, gallery = tables(spark, q, p, labels)
        got = {r.qid: (r.label, r.score, r.margin) for r in I.votes(queries, gallery, scratch, groups=2 * n, margin=False).collect()}
        same(got, {k: (*w[:2], None) for k, w in brute(range(25), q, p, labels).items()})
        visits = [spark.read.parquet(scratch.path(f"{k}-visits")) for k in ("first", "second")]
        size = spark.read.parquet(scratch.path("assigned")).groupBy("group").agg(F.count("*").alias("n"))
        work.append(sum(v.join(size, "group").agg(F.sum("n")).first()[0] or 0 for v in visits))
        assert work[-1] < 25 * 12 * n * 0.7
    assert work[1] < 2.5 * work[0]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_three_nearest_resist_one_lucky_prototype(spark):
    angle = np.arccos([0.99, 0.10, 0.10, 0.10, 0.80, 0.79, 0.78])
    p = np.stack((np.cos(angle), np.sin(angle)), axis=1)
    for n in (100, 3):
        queries, gallery = tables(spark, [[1.0, 0.0]], p, list("AAAABBB"), "string")
        assert [r.label for r in M.prototype_votes(queries, gallery, bound=n).collect()] == ["B"]
