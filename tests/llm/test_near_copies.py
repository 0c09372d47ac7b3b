"""The near_dedup stage of the pipeline against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from trackloom.llm import line_templates, near_copies, secrets, simhash


@pytest.mark.parametrize("tile", [near_copies.TILE, 400])
def test_near_dedup_stage_drops_planted_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(8)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 200))]
        for changes in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for p in rng.sample(range(len(w)), changes):
                w[p] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    hub = [f"h{i}" for i in range(120)]  # a large group of copies, each pair near or not
    texts += [" ".join([*hub[:i], f"y{i}", *hub[i + 1 :]]) for i in range(120)]
    texts += ["", " ", None, "short text", "Short  TEXT", "other text"]
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {i for i, r in enumerate(root) if i == r}
    assert corpus_pipeline.near_dedup(spark, docs.where("doc_id < 0"), "").collect() == []
    nameless = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (4, "A b c"), (None, "d")], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.near_dedup(spark, nameless, "").collect()) == [-1, -1, 3]


def test_bands_at_the_threshold():
    rng = np.random.default_rng(4)
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)))) for _ in range(2))
        assert near_copies.similar(a, b) and (near_copies.bands(a) == near_copies.bands(b)).any()


def test_columns_with_dots_pass_all_stages(spark):
    """Names that need quotes, and some that operators use themselves."""
    text = "one line of words here that nobody else has written down before today\nand a second line so that it is long enough to stay"
    rows = [(1, text, 5, "x", 1.5, 2), (2, text, 5, "y", 2.5, 3), (None, None, 0, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `a.b` string, `c``d.e` double, key int")
    for stage in (near_copies.first_of_each_group, simhash.first_of_each_group, secrets.redact_documents, line_templates.deduplicate):
        out = stage(df)
        assert out.columns == df.columns
        kept = {r.doc_id: (r["a.b"], r["c`d.e"], r.key) for r in out.collect()}
        assert kept[1] == ("x", 1.5, 2) and kept[None] == (None, None, None)
