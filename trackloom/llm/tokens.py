"""Tokenising whole texts by a ``tokenizers`` file.

The library itself encodes about 1.8 MB of text a second and core. For the two
common byte-level layouts (plain, and lower-cased with word ends) the same
vocabulary and merge order run several times faster on tiktoken's merge loop, so
texts whose code points both libraries surely class alike (below U+0530: Latin,
Greek, Cyrillic) and that spell no added token take that way and all others the
library, at its defaults. Tests hold the two
against each other.
"""

from __future__ import annotations

import bisect
import json
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from trackloom.llm.arrowio import map_rows

#: The split pattern of plain byte-level BPE, and that of the word-end layout.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OTHER = re.compile("[^\x00-\x1b\x20-ԯ]")
_OTHER_LOWER = re.compile("[^\x00-\x1b\x20-΢Τ-ԯ]")  # nor the capital sigma, whose lower case depends on its place


def _apart() -> re.Pattern:
    """Single numbers, and runs of what is neither letter, number nor white space."""
    known = [chr(i) for i in range(0x530)]
    numbers = "".join(c for c in known if unicodedata.category(c)[0] == "N")
    others = "".join(c for c in known if unicodedata.category(c)[0] not in "LN" and not c.isspace())
    return re.compile(f"[{re.escape(numbers)}]|[{re.escape(others)}]+")


_APART = _apart()
_WHITE = "\t\n\x0b\x0c\r\x85\xa0"


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class FileTokenizer:
    """``encode(text)`` gives the ids of ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)`` as an array; a string that spells an added token is
    that token, as there."""

    def __init__(self, path: str, fast: bool = True):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = tuple({t["content"].lower() for t in spec.get("added_tokens", [])})
        self.way = self._way(spec) if fast else None

    def _way(self, spec: dict):
        import regex
        import tiktoken

        model, pre, norm = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            return None
        chars, special = _byte_chars(), {t["content"] for t in spec.get("added_tokens", [])}
        end = model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            tail = b" " if end and token.endswith(end) else b""
            return bytes(chars[c] for c in (token[: -len(end)] if tail else token)) + tail

        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None and not end:
            ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
            return self._plain, tiktoken.Encoding("file", pat_str=PLAIN, mergeable_ranks=ranks, special_tokens={})
        parts = pre.get("pretokenizers", [])
        if end and len(parts) == 2 and parts[0].get("pattern") == {"Regex": WORDS} and parts[0].get("invert") and norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            # A piece is followed by one space, which stands for the word end; (byte, word end) pairs precede all merges.
            ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
            self.pieces = regex.compile(WORDS)
            return self._words, tiktoken.Encoding("file", pat_str=r"\S+ ", mergeable_ranks=ranks, special_tokens={})
        return None

    def encode(self, text: str) -> np.ndarray:
        if self.way and not self._spells(text) and (out := self.way[0](text, self.way[1])) is not None:
            return out
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _spells(self, text: str) -> bool:
        low = text.lower()
        return any(t in low for t in self.added)

    def _plain(self, text: str, enc) -> np.ndarray | None:
        if not _latin(text) and _OTHER.search(text):
            return None
        return _ids(enc, text)

    def _words(self, text: str, enc) -> np.ndarray | None:
        if not _latin(text):  # Latin-1 is always in composed form
            # marks may compose with symbols below U+0530 to one beyond: ask again
            if _OTHER_LOWER.search(text) or _OTHER_LOWER.search(text := unicodedata.normalize("NFC", text)):
                return None
        elif any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return None
        text = text.lower()
        text = self.pieces.sub(r" \g<0> ", text) if "'" in text else _APART.sub(r" \g<0> ", text)
        for c in _WHITE:
            if c in text:
                text = text.replace(c, " ")
        return _ids(enc, text + " ")


def _ids(enc, text: str) -> np.ndarray:
    ids = enc._core_bpe.encode_ordinary(text)
    return np.fromiter(ids, "<u4", len(ids))


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def encode_documents(docs: DataFrame, path: str, end_id: int, bounds: list[int] | None = None) -> DataFrame:
    """``(doc_id, n, ids, shard)``: ids with ``end_id`` appended, as unsigned 16-bit
    little-endian bytes where the vocabulary allows, else 32-bit. Null text counts
    as empty; repeated rows stay; other columns are ignored. ``shard`` counts the
    ``bounds`` at or below doc_id (null: 0)."""

    def make():
        tok = FileTokenizer(path)
        kind = "<u2" if max(tok.size, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()

        def rows(cols):
            for d, t in zip(*cols, strict=True):
                ids = tok.encode(t or "")
                yield d, len(ids) + 1, ids.astype(kind).tobytes() + end, 0 if d is None or not bounds else bisect.bisect_right(bounds, d)

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n long, ids binary, shard int", make)


def unpack(ids: bytes, n: int) -> np.ndarray:
    """Back to 32-bit ids from either width."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
