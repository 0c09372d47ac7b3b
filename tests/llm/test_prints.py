"""Content-defined chunks byte by byte, and documents in order."""

import hashlib
import random

import pytest
import xxhash

from trackloom.llm import chunk_prints as c

SCHEMA = "doc_id long, text string, role int, place int, fingerprint string, n_chars long"


def slow_ends(data):
    """One byte after the other."""
    out, start, h = [], 0, 0
    for i, b in enumerate(data):
        h = (h * 2 + int(c.GEAR[b])) & 0xFFFF
        n = i + 1 - start
        passed = h < 1 << (16 - (c.STRICT if n < c.NORMAL else c.LOOSE))
        if n >= c.LEAST and passed or n == c.MOST or i + 1 == len(data):
            out.append(i + 1)
            start = i + 1
    return out


def slow_print(text):
    data, a, out = (text or "").encode(), 0, {}
    for b in slow_ends(data):
        out[xxhash.xxh3_64_intdigest(data[a:b]) >> 22, b - a] = data[a:b]
        a = b
    return out


def slow_likeness(a, b):
    if not a or not b:
        return float(set(a) == set(b))
    return sum(n for d, n in a if (d, n) in b) / sum(n for _, n in a)


def brute(rows):
    ids = [(i, t or "") for i, t in rows]
    order = sorted((r for r in ids if r[0] is not None), key=lambda r: (-r[0], r[1].encode()))
    pairs = [(a, order[(k + 1) % len(order)][1]) for k, a in enumerate(order)] + [(r, None) for r in ids if r[0] is None]
    out = []
    for (i, t), nxt in pairs:
        half = len(t) // 2
        new = t[: len(t) - half] + (nxt or "")[:half]
        own, changed, its = slow_print(t), slow_print(new), slow_print(nxt)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), c.fingerprint(t), c.fingerprint(new), slow_likeness(own, changed), slow_likeness(own, its)))
    return sorted(out, key=str)


def printed(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 5, 6, "f", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in c.with_next(docs).collect()), key=str)


@pytest.fixture(params=[1 << 20, 3000, 200])
def block(request, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", request.param)


def test_chunks_byte_by_byte(texts, block):
    for t in [*texts, "ab" * 500, "\x00" * 300]:
        data = (t or "").encode()
        assert c.chunk_ends(data) == slow_ends(data)
        assert {(x >> 6, (x & 63) + 1) for x in c.chunked(data).set()} == set(slow_print(t))


def test_known_chunks_are_used_rightly(texts, block):
    for a, b in zip(texts, texts[1:], strict=False):
        a, b = a or "", b or ""
        stays, new = (x.encode() for x in c.edited(a, b))
        assert c.chunked(stays + new, c.chunked(a.encode()), len(stays)) == c.chunked(stays + new)


def test_written_form(texts):
    for t in texts:
        assert c.read(c.fingerprint(t)) == c.chunked((t or "").encode()).set()
        assert c.likeness(c.fingerprint(t), c.fingerprint(t)) == 1.0
    assert (c.likeness("", c.fingerprint("x")), c.likeness(c.fingerprint("x"), "")) == (0.0, 0.0)


def test_order_and_cases(spark, texts):
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(6, texts[2]), (6, "another of 6"), (6, None), (None, "no id"), (None, None), (None, "no id"), (-5, texts[8])]
    assert printed(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(4, "one document alone, next to itself")], [(None, "x y z")], [(None, "x y z"), (1, "é" * 80)], [(1, "same"), (1, "same"), (1, "same")]])
def test_few_rows(spark, rows):
    assert printed(spark, rows, 1) == brute(rows)


def test_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10**12), " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(40))) for _ in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert printed(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shifted_passage_is_found():
    rng = random.Random(8)
    words = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (300, 7, 400, 400)]
    passage, head, tail, other = words
    inside = c.fingerprint(f"{head}! {passage} {tail}")
    assert c.likeness(c.fingerprint(passage), inside) > 0.9
    assert c.likeness(inside, c.fingerprint(passage)) < 0.6
    assert c.likeness(c.fingerprint(other), inside) < 0.01
