"""The near_dedup stage takes candidates from the covering of fingerprints."""

import corpus_pipeline
from trackloom.llm import near_copies, simhash
from trackloom.plans.runtime import Scratch


def test_covering_gives_candidates(spark, monkeypatch):
    called, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, *a: (called.append(1), links(fps, *a))[1])
    base = [f"w{i}" for i in range(600)]
    texts = [" ".join(base), " ".join(base[:300] + ["x"] + base[301:]), " ".join(base) + " ", "some other text"]
    bits = (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_copies.sketches(docs).localCheckpoint()
    pairs = near_copies._covered(rows, Scratch(spark, "t")).collect()
    assert called and len(pairs) == (bits <= 2) == 1
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 3] and len(called) == 2
