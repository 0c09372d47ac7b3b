"""Tokens, packing, files, BPE tree, quality rules, secrets, pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from trackloom.llm import bpe_tree, debruijn_dedup, line_templates, packing, quality, secrets, token_files, tokens
from trackloom.llm.queries import vocabulary

ODD = ["a  b", "a \n b", "  x\t\ty  ", "don't  'll 's i'sx !'s", "a\xa0 b 　c", "x\x1c y\x1cz!", "é é ́z Σς ΑΣ ", "<|endoftext|> a<|endoftext|>b", "12 34ab  \r\n\r\n q", "🙂🙂 🙂", "a_b __ x²3½ 9", "İstanbul ẞ", "--- ... ,,!x?!"]


@pytest.fixture(scope="module")
def ranks():
    return bpe_tree.load_ranks(vocabulary("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_tokens_equal_the_library(texts, name):
    t = tokens.FileTokenizer(vocabulary(name))
    assert t.way
    for x in [*[x or "" for x in texts], *ODD]:
        assert t.encode(x).tolist() == t.tok.encode(x, add_special_tokens=False).ids, x[:40]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sT19 \n\t.,!_é́ß²中\U0001f642"), max_size=60))
def test_fast_tokens_on_random_text(x):
    for t in _both():
        assert t.encode(x).tolist() == t.tok.encode(x, add_special_tokens=False).ids


def test_fast_tokens_on_marks():
    """Marks that compose with letters, and with symbols to others beyond U+0530."""
    rng = random.Random(6)
    marks = "".join(map(chr, range(0x300, 0x346))) + "\u0338\u0338\u0338\u0327\u0301"
    cases = ["a>\u0338", "x|=\u0338y", "->\u0338", "(=\u0338)", "<\u0338 A\u030a\u2126\u212a"] + ["".join(rng.choice("=<>~|!-( aAeoZ19'" + marks) for _ in range(rng.randint(1, 12))) for _ in range(4000)]
    for t in _both():
        for x in cases:
            assert t.encode(x).tolist() == t.tok.encode(x, add_special_tokens=False).ids, ascii(x)


_made: list = []


def _both():
    if not _made:
        _made.extend(tokens.FileTokenizer(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    return _made


@pytest.mark.parametrize("leaf", [5, 1024])
def test_tree_equals_the_library(texts, ranks, leaf):
    import public_tokenizers

    t = bpe_tree.TreeBPE(ranks, public_tokenizers.PATTERN, leaf, min(leaf, 64))
    for x in [*[x or "" for x in texts if len(x or "") < 5000 or leaf > 5], *ODD, "ab" * 4000, " " * 3000]:
        ids = t.encode(x)
        assert ids == t.enc.encode_ordinary(x), x[:40]
        assert t.decode(ids) == x.encode()


def test_tree_query(documents, empty):
    import public_tokenizers

    args = (vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    got = bpe_tree.digests(documents, *args).collect()
    assert len(got) == documents.count() and all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in got)
    assert all(bytes(r.decoded) == text[r.doc_id].encode() for r in bpe_tree.encode_documents(documents, *args).collect())
    assert bpe_tree.digests(empty, *args).collect() == []


class Library:
    """The tokenizers library as it is."""

    def __init__(self, path):
        self.tok = Tokenizer.from_file(path)

    def encode(self, text):
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")


def test_rows_without_id(nameless):
    """Null ids and null texts, with columns of clashing names."""
    import public_tokenizers

    three = lambda df: sorted((r.doc_id is None) + 0 for r in df.collect()) == [0, 1, 1]
    assert three(token_files.round_trip(nameless, vocabulary("word_bpe_49k.json")))
    pieces = packing.pack_documents(nameless, vocabulary("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in pieces} == {None, 4} and sum(r.length for r in pieces if r.doc_id is None) == 7
    assert three(bpe_tree.digests(nameless, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
    assert three(secrets.scan_documents(nameless)) and three(quality.judge(nameless, []))
    assert three(line_templates.deduplicate(nameless)) and three(debruijn_dedup.deduplicate(nameless))
    for df in (secrets.redact_documents(nameless), line_templates.deduplicate(nameless)):
        assert df.columns == nameless.columns and df.where("doc_id is null and text is null").count() == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_texts_that_spell_added_tokens(name):
    own, lib = tokens.FileTokenizer(vocabulary(name)), Library(vocabulary(name))
    for t in ("hello <|endoftext|> world", "a<|endoftext|>b", "<|EndOfText|>", "<|startoftext|> x <|endoftext", "<|endoftext|>"):
        assert own.encode(t).tolist() == lib.encode(t).tolist()


def test_packing(documents, empty):
    path = vocabulary("byte_bpe_50k.json")
    lib = Library(path)
    want = Counter((r.doc_id, bytes(np.append(lib.encode(r.text or ""), 0).astype("<u4"))) for r in documents.collect())
    rows = packing.digest(packing.pack_documents(documents, path, window=128)).collect()
    lengths, fill = Counter(), {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == 128 or at & (at - 1) == 0
    assert sum(lengths.values()) == sum(len(b) // 4 * n for (_, b), n in want.items())
    once = {d: b for d, b in want}
    for d in {d for d, b in want if want[d, b] == 1}:
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(once[d]) // 4 and r.ids_crc32 == zlib.crc32(once[d][4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(once[d]) // 4
    assert packing.pack_documents(empty, path).collect() == []


def test_fitted_counts_use_what_is_there():
    hist = np.zeros(64, np.int64)
    hist[[10, 54, 20, 22, 7]] = [100, 100, 30, 60, 5]
    p = packing.Plan(hist, 64)
    placed = Counter()
    for n in np.flatnonzero(hist):
        for k in range(hist[n]):
            for _, length, seq, at in p.places(int(n), k):
                assert not any((seq, at + i) in placed for i in range(length))
                placed.update((seq, at + i) for i in range(length))
    assert p.filled >= 100 and len(placed) == (hist * np.arange(64)).sum()


def test_token_files(spark, documents, empty, tmp_path):
    path = vocabulary("word_bpe_49k.json")
    lib = Library(path)
    want = [(r.doc_id, bytes(np.append(lib.encode(r.text or ""), 1).astype("<u4"))) for r in documents.collect()]
    got = token_files.round_trip(documents, path, shard_bytes=4000).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(b) // 4, zlib.crc32(b)) for d, b in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(d for d, _ in want)
    folder = f"file://{tmp_path}/store"
    manifest = token_files.write(documents, folder, path, 1, shard_bytes=4000)
    assert len(manifest) > 2
    keys = spark.createDataFrame([(6,), (1,), (10**9,)], "doc_id long")
    assert [r.doc_id for r in token_files.read(keys, folder, manifest).collect()] == [6]
    assert token_files.round_trip(empty, path).collect() == []


@settings(max_examples=30, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=80))
def test_minimal_perfect_hash(keys):
    move, slot = token_files.build_index(sorted(keys))
    assert sorted(slot.tolist()) == list(range(len(keys)))


def slow_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(win)
    rep = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(rep)


def test_statistics(documents, empty):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in quality.judge(documents, []).collect():
        want = slow_statistics(text[r.doc_id])
        assert tuple(r[c] for c in cols) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(empty, []).collect() == []


def test_decision_list_on_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    rules = quality.learn(docs, seen)
    j = quality.judge(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi"), rules).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    clean = [r for r in j if r.quality == 1 and not r.base_failed]
    junk = [r for r in j if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean) and sum(not r.kept for r in junk) >= 0.95 * len(junk)
    assert quality.learn(docs, labels.where("doc_id < 0")) == []


def test_fit_finds_the_threshold():
    rng = random.Random(0)
    rows = [{f: rng.random() for f in quality.FEATURES} | {"fold": i % 3} for i in range(900)]
    for r in rows:
        r["bad"] = int(r["repeat_share"] > 0.7 and r["upper_share"] < 0.5)
    rules = quality.fit(rows, min_precision=0.95)
    hit = [any(all(c.holds(r) for c in rule) for rule in rules) for r in rows]
    assert np.mean([h == bool(r["bad"]) for h, r in zip(hit, rows, strict=True)]) > 0.97


def test_native_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality.judge(docs, [[quality.Condition("repeat_share", True, 0.5)]])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def slow_base(text):
    out = [("assign", m) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(((m.start(), m.end(), k) for k, m in out), key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


@settings(max_examples=300, deadline=None)
def speaks_for(text, weak, other):
    (a, b, kind), (s, e, q) = weak, other
    if kind == "part":
        return q in ("access", "id", "endpoint")
    if q == "assign":
        value = re.split("[:=]\x20*[\"']?", text[s:e], maxsplit=1)[1]
        return not re.fullmatch("[A-Za-z][a-z]+[.,]?", value)
    return q == "part" or q == "hex" and (kind == "id" or bool(re.search("://[^/ ]*@", text[a:b])))


@given(st.lists(st.sampled_from(["secret=", "token:", "tokeN", "API_KEY = '", "apikey", "AKIA", "0123456789ab", "QWERTYUIOP12", "abcdef", " ", "\n", "=", "x", "é", " https://h.example/p", "user=bob1", " ftp://bob:x@h.example ", "password: required ", "0123456789abcdef01234567 ", " kQ3v9ZpL0s7Xw2Rt8Yb4Nd6Mf1Hg5Jc ", "word " * 21]), max_size=14))
def test_secret_spans(parts):
    """Base spans, and exactly the weak ones with company, by all pairs."""
    text = "".join(parts)
    base, every = secrets.scan(text)
    assert base == slow_base(text) and [s for s in every if s[2] in ("assign", "access", "hex")] == base
    weak = secrets.weak_parts(text, base)
    want = set()
    for a, b, k in weak:
        for s, e, q in [*base, *weak]:
            if speaks_for(text, (a, b, k), (s, e, q)) and (0 <= s - b <= 200 or 0 <= a - e <= 200):
                want.add((a, b, k))
    assert {s for s in every if s not in base} == want


def test_paths_and_addresses_are_no_credentials():
    for text in (
        "See https://example.com/blog/2024/11/how-to-train-large-models-in-7-steps for more.",
        "https://example.com . Install into /usr/local/lib/python3/dist-packages/numpy/core",
        "login: bob99 wrote the-quick-brown-fox-jumps-over-13-lazy-dogs today",
        "https://example.com/kQ3v9ZpL0s7Xw2Rt8Yb4Nd6Mf1Hg5Jc9A",
    ):
        assert secrets.scan(text)[1] == [] and secrets.redact(text) == text
    for text in (
        f"See https://example.com/docs and commit {'0a1b' * 10}",
        f"wget https://example.com/a.tar.gz\nsha256 {'0a1b' * 16}",
        "login: please read https://example.org/faq ; password: required",
    ):
        base, every = secrets.scan(text)
        assert base and every == base  # the base kinds stay, nothing weak beside them
    assert [k for _, _, k in secrets.scan("see https://example.org/faq , password: x9Kq2pLm")[1]] == ["endpoint", "assign"]
    assert [k for _, _, k in secrets.scan(f"ftp://bob@h.example {'0a1b' * 10}")[1]] == ["endpoint", "hex"]


def test_weak_parts_need_company(spark, documents, empty):
    part = "kQ3v9ZpL0s7Xw2Rt8Yb4Nd6Mf1Hg5Jc9A"
    assert secrets.scan(f"just {part} alone")[1] == []
    assert [k for _, _, k in secrets.scan(f"login: bob99 uses {part} at https://db.example/x")[1]] == ["id", "part", "endpoint"]
    assert secrets.scan(f"login: bob99 {'word ' * 100}{part}")[1] == []
    assert secrets.redact(f"user=bob99 {part}!") == "user=[id] [part]!" and secrets.redact(None) is None
    assert secrets.scan_documents(documents).count() == documents.count() and secrets.scan_documents(empty).collect() == []
    assert secrets.redact_documents(documents).columns == documents.columns


def test_pipeline(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, steps = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality_rules", "line_dedup", "near_dedup", "secret_scan", "packing")
    seen = docs
    for step in steps[:-1]:
        out = step(spark, seen, str(tmp_path))
        assert out.columns == docs.columns
        assert out.select("doc_id").join(seen, "doc_id", "left_anti").count() == 0
        seen = spark.createDataFrame(out.collect(), out.schema)
    got = corpus_pipeline.run(spark, str(tmp_path))
    text = {r.doc_id: r.text for r in seen.collect()}
    assert {r.doc_id for r in got.select("doc_id").collect()} == set(text)
    lib = Library(vocabulary("byte_bpe_50k.json"))
    assert got.agg({"length": "sum"}).first()[0] == sum(len(lib.encode(t or "")) + 1 for t in text.values())
    assert not any(secrets.base_spans(t or "") for t in text.values())
