"""A passage twice in one document that an earlier document holds in part."""

import hashlib
import random

import pytest

from trackloom.llm import batches, suffix_dedup


@pytest.fixture(autouse=True, scope="module")
def small_batches():
    kept = batches.Store.__init__.__defaults__
    batches.Store.__init__.__defaults__ = (None, 3000)
    yield
    batches.Store.__init__.__defaults__ = kept


def test_every_copy_of_a_partly_known_passage_goes(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(0, 120, 4):
        s, cut = some(200), rng.randint(50, 140)
        rows.append((i, some(80) + s[:cut] + some(70)))
        again = (i + 1, some(60) + s + some(90) + s + some(30))
        rows += [again, again] if i % 8 else [again]  # repeated rows too
        rows.append((i + 2, some(50) + s[20:] + some(20)))
    rng.shuffle(rows)
    first: dict = {}
    for d, t in sorted(rows):
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], d)
    want = {}
    for d, t in rows:
        gone = {k + j for k in range(len(t) - 49) if first[t[k : k + 50]] < d for j in range(50)}
        want[d] = len(gone), hashlib.sha256("".join(c for k, c in enumerate(t) if k not in gone).encode()).hexdigest()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.deduplicate(docs, digest=True).collect()
    assert len(got) == len(rows)
    assert [r for r in got if (r.n_removed, r.kept_sha256) != want[r.doc_id]] == []


def test_suffix_behind_a_common_prefix(spark):
    """25 bytes in common, 25 of their own: nothing is repeated. Second names of 32 bits
    would take some of these texts for one another."""
    docs = spark.range(120_000).selectExpr("id AS doc_id", "concat('the same twenty-five bytes', substr(sha2(cast(id AS string), 256), 1, 24)) AS text")
    out = suffix_dedup.deduplicate(docs, digest=True)
    assert out.where("n_removed > 0").count() == 0 and out.count() == 120_000
