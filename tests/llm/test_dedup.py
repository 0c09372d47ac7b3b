"""SimHash, lines, suffixes, substrings and vectors against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from trackloom.llm import batches, debruijn_dedup, line_templates, simhash, suffix_dedup, vectors

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True, scope="module")
def small_batches():
    """Several batches, so that answers cross them."""
    kept = batches.Store.__init__.__defaults__
    batches.Store.__init__.__defaults__ = (None, 9000)
    yield
    batches.Store.__init__.__defaults__ = kept


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(texts):
    for t in texts:
        assert simhash.fingerprint(t) == slow_fingerprint(t)


def test_links_are_complete(spark):
    rng = random.Random(1)
    fps = {0, (1 << 64) - 1}
    for _ in range(150):
        x = rng.getrandbits(64)
        fps.add(x)
        for k in (1, 2, 3):
            y = x
            for b in rng.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    got = {tuple(sorted((r.src % 2**64, r.dst % 2**64))) for r in simhash.links(df).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert got == want


def test_near_duplicates(spark, documents, empty, nameless):
    rows = simhash.near_duplicates(documents).collect()
    docs = documents.collect()
    ids = [r.doc_id for r in docs]
    f = {r.doc_id: slow_fingerprint(r.text) for r in docs}
    assert len(rows) == len(docs) and all(r.fingerprint == f"{f[r.doc_id]:016x}" for r in rows)
    u = sorted(set(ids))
    c = components(len(u), [(i, j) for i in range(len(u)) for j in range(i) if (f[u[i]] ^ f[u[j]]).bit_count() <= 2])
    want = {d: u[c[i]] for i, d in enumerate(u)}
    assert all(r.component_id == want[r.doc_id] for r in rows)
    assert simhash.near_duplicates(empty).collect() == []
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(nameless).collect()) == [(-1, -1), (-1, 4), (4, 4)]
    kept = simhash.first_of_each_group(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {d for d in u if want[d] == d}


def brute_bytes(rows, n):
    first = {}
    for d, b in sorted(rows, key=lambda r: r[0]):
        for s in range(len(b) - n + 1):
            first.setdefault(b[s : s + n], d)
    out = {}
    for d, b in rows:
        g = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < d:
                g[s : s + n] = b"\1" * n
        out[d] = (len(b), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest())
    return out


def test_suffixes(documents, empty, nameless):
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.collect()]
    want = brute_bytes(rows, 50)
    got = suffix_dedup.deduplicate(documents, digest=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.deduplicate(empty).collect() == []
    assert suffix_dedup.deduplicate(nameless).count() == 3


def test_substrings(documents, empty):
    rows = [(r.doc_id, WORD.findall((r.text or "").encode())) for r in documents.collect()]
    c = Counter(tuple(w[s : s + 35]) for _, w in rows for s in range(len(w) - 34))
    got = defaultdict(list)
    for r in debruijn_dedup.deduplicate(documents, digest=True).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    for d, w in rows:
        g = bytearray(len(w))
        for s in range(len(w) - 34):
            if c[tuple(w[s : s + 35])] > 1:
                g[s : s + 35] = b"\1" * 35
        kept = b" ".join(x for x, y in zip(w, g, strict=True) if not y)
        assert (len(w), sum(g), hashlib.sha256(kept).hexdigest()) in got[d]
    assert debruijn_dedup.deduplicate(empty).collect() == []


def test_random_strings_over_a_small_alphabet(spark):
    """Many partial overlaps: the branching rounds."""
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(60, 140))) for _ in range(6)]
    rows = []
    for i in range(80):
        p = "".join(x[(a := rng.randrange(40)) : a + rng.randint(20, 90)] for x in rng.sample(pool, 3))
        rows.append((i, p))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_bytes([(d, t.encode()) for d, t in rows], 50)
    for r in suffix_dedup.deduplicate(df, digest=True).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    words = [(d, WORD.findall(t.encode())) for d, t in rows]
    c = Counter(tuple(w[s : s + 8]) for _, w in words for s in range(len(w) - 7))
    for r in debruijn_dedup.deduplicate(df, window=8, kmer=5).collect():
        w = words[r.doc_id][1]
        assert r.n_removed == len({s + k for s in range(len(w) - 7) for k in range(8) if c[tuple(w[s : s + 8])] > 1})


def test_lines(spark, documents, empty):
    rows = [(1, "Alpha beta gamma delta\nunique one here\nvisit 17 of user 9"), (2, "Alpha beta gamma delta\n\nvisit 23 of user 4"), (3, "Alpha  beta gamma delta\nvisit 5 of user 8\nmore"), (4, None), (5, "")]
    rows += [(10 + i, f"the server named {n} went down at last today") for i, n in enumerate(("mars", "venus", "pluto", "ceres"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.text for r in line_templates.deduplicate(df).collect()}
    assert got[1] == rows[0][1] and got[2] == "" and got[3] == "more" and got[4] is None and got[5] == ""
    assert got[10] == rows[5][1] and [got[i] for i in (11, 12, 13)] == ["", "", ""]
    d = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_templates.deduplicate(df, mode="digest").collect()}
    assert d[1] == (3, 0) and d[2] == (2, 2) and d[4] == (0, 0)
    out = line_templates.deduplicate(documents)
    assert out.columns == documents.columns and out.count() == documents.count() and out.where("extra != 'e' or answers != 1").count() == 0
    assert line_templates.deduplicate(empty).collect() == []


def brute_lines(rows, min_docs=3, share=0.6):
    """Every line at every level of frequency, by its tokens as they stand, and what
    each document keeps."""
    lines = []
    for k, (d, t) in enumerate(rows):
        for i, line in enumerate((t or "").encode().split(b"\n")):
            if w := [None if re.search(rb"[0-9@]|://", x) else x for x in WORD.findall(line)]:
                lines.append((k, d, i, w))

    def leaf(w):
        return len(w), *w[:3]

    held = defaultdict(set)  # documents by leaf, position and token
    for k, _, _, w in lines:
        for p, x in enumerate(w):
            held[leaf(w), p, x].add(k)
    level = {key: math.floor(math.log(len(ks) / min_docs) / math.log(1.1)) for key, ks in held.items() if len(ks) >= min_docs}
    least, seen = defaultdict(dict), []
    for k, d, i, w in lines:
        for m in range(max(level.values(), default=-1) + 1):
            fixed = {p for p, x in enumerate(w) if x and level.get((leaf(w), p, x), -1) >= m}
            tail = len(fixed - {0, 1, 2})
            letters = any(re.search(rb"[A-Za-z\x80-\xff]", w[p]) for p in fixed)
            if len(fixed) >= share * len(w) and letters and (m == 0 or tail >= (len(w) - 3) / 2):
                t = leaf(w), tuple((p, w[p]) for p in sorted(fixed))
                least[t][k] = d
                seen.append((t, k, d, i))
    gone = {(k, i) for t, k, d, i in seen if len(least[t]) >= min_docs and d > min(least[t].values())}
    return [(d, "\n".join(x for i, x in enumerate((t or "").split("\n")) if (k, i) not in gone)) for k, (d, t) in enumerate(rows)]


@pytest.mark.parametrize("values", [2, 3, 5, 20])
def test_fields_stay_fields_as_data_grow(spark, values):
    """A field's values recur the more the larger the corpus; its template still does."""
    rng = random.Random(values)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(2 * values)]
    rows = [(i, f"the registered user named {names[i % values]} has just signed in from {names[values + i // values % values]} on this site") for i in range(values * values)]
    got = {r.doc_id: r.text for r in line_templates.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: t if i == 0 else "" for i, t in rows}


def test_growing_keeps_dropping(spark):
    rng = random.Random(12)
    line = lambda: f"a message from {rng.choice('ABCDE')}{rng.choice('xyz')} was left for {rng.choice('PQRS')}{rng.choice('uvw')} at the front desk"
    rows, before = [(i, line()) for i in range(400)], set()
    for n in (6, 12, 25, 50, 100, 200, 400):
        got = line_templates.deduplicate(spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(2)).collect()
        gone = {r.doc_id for r in got if not r.text}
        assert before <= gone
        before = gone
    assert len(before) == 399


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_against_counting(spark, texts, parts):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(texts)]
    names = ["mars", "venus", "pluto", "ceres", "juno", "vesta"]
    for i in range(100, 160):
        own = [f"the server {rng.choice(names)} went down {rng.choice(['today', 'again', str(i)])} said {rng.choice(names)} at last", "3.14 2.71", "}", "see https://a.b/c now please", f"{rng.choice(names)} {i}", "cut here", "a b c d e f g"]
        rows.append((i, "\n".join(rng.sample(own, 4)) + "\n" + own[0]))
    rows += [rows[-1], rows[-2]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    want = Counter((d, t) for d, t in brute_lines(rows))
    assert Counter((r.doc_id, r.text or "") for r in line_templates.deduplicate(df).collect()) == want
    digests = Counter((r.doc_id, r.kept_sha256) for r in line_templates.deduplicate(df, mode="digest").collect())
    assert digests == Counter({(d, hashlib.sha256(t.encode()).hexdigest()): n for (d, t), n in want.items()})
    assert sum("3.14 2.71" in t and "}" in t for _, t in want) > 20  # lines without a fixed word stay


def test_templates_count_documents(spark):
    """Two fillings in one document are one document, and batches change nothing."""
    line = "alpha beta gamma {} delta omega".format
    rows = [(1, line("x") + "\n" + line("y")), (2, line("z")), (3, "alpha beta gamma other words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_templates.deduplicate(df).collect()} == dict(rows)
    some = [(i, line("q" * i)) for i in range(1, 11)]
    for parts in (1, 8):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(parts)
        assert sum(r.text == "" for r in line_templates.deduplicate(df).collect()) == 9


def test_lines_with_odd_columns(spark):
    df = spark.createDataFrame([(None, "a", 1, 2.5, "x"), (None, None, None, None, None), (5, "", 3, 4.5, "y")], "doc_id long, text string, _null int, `a.b` double, missing string")
    got = line_templates.deduplicate(df)
    assert got.columns == df.columns and sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("size", [120_000])
def test_long_texts_are_cut_and_joined(spark, size):
    """Texts of many batches, whose repeats lie across the cuts."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(size // 6))
    rows = [(1, long), (2, "head " + long[30_000:60_000] + " tail " + long[40_000:45_000]), (3, " ".join(word() for _ in range(3000))), (4, long[10:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = brute_bytes([(d, t.encode()) for d, t in rows], 50)
    got = suffix_dedup.deduplicate(df, digest=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    words = {d: WORD.findall(t.encode()) for d, t in rows}
    c = Counter(tuple(w[s : s + 35]) for w in words.values() for s in range(len(w) - 34))
    for r in debruijn_dedup.deduplicate(df, digest=True).collect():
        w = words[r.doc_id]
        g = {s + k for s in range(len(w) - 34) if c[tuple(w[s : s + 35])] > 1 for k in range(35)}
        assert (r.n_words, r.n_removed) == (len(w), len(g))
        assert r.kept_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest()


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(40, 24))
    v = (centre[rng.integers(0, 40, 400)] + rng.normal(size=(400, 24)) * rng.choice([0.0, 0.1, 0.25, 0.5], (400, 1))).astype(np.float32)
    rows = [(i, [float(y) for y in x], 0) for i, x in enumerate(v)]
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] + [1.0] * 23, 0), (1003, [None] + [1.0] * 23, 0), (1004, [], 0), (1005, [1.0, 2.0], 0), (1006, [1.0, 2.0], 0), (1007, [float("inf")] * 24, 0), (None, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    x = v.astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / np.outer(n, n) >= 0.95
    np.fill_diagonal(near, False)
    c = components(400, zip(*np.nonzero(near), strict=True))
    for i in range(400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum(), c[i], c[i] == i)
    for i in (1000, 1001, 1002, 1003, 1004, 1007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[1006].n_links, got[1006].component_id, got[None].component_id, got[None].kept) == (1, 1005, None, True)
    assert vectors.near_duplicates(df.where("vec_id < 0")).collect() == []


def test_vectors_of_one_id_and_of_any_size(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [-4.0, 3.0, -2.0, 1.0]
    rows = [(1, a), (1, b), (2, [1.0, 2.0, 3.0, 4.1]), (3, b), (7, [x * 1e-170 for x in a]), (8, [x * 1e160 for x in a]), (9, [5e-324, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 1, False), (7, 3, 1, False), (8, 3, 1, False), (9, 0, 9, True)]
