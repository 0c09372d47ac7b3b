"""Byte-level BPE as a monoid: encode halves, join neighbours.

Text level. A space or newline after a character that isn't white space always
starts a new match of the split pattern, so text may be cut there freely. To join
two encoded halves only the window between the last such place on the left and
the first on the right is encoded again; it grows (doubling its reach) until it
has both or meets the ends.

Match level. A single long match (no white space for thousands of bytes) is
halved as bytes. Its halves are joined by re-encoding a few tokens on either side
of the boundary. A token sequence is the BPE encoding of its bytes if and only if
every two neighbours are what BPE makes of their joint bytes; so once the window's
first and last tokens agree with the tokens next to them, nothing outside changes.

Decoding looks up each leaf's tokens and concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import DataFrame

from trackloom.llm.arrowio import map_rows

LEAF, MATCH_LEAF = 1024, 256


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, match_leaf: int = MATCH_LEAF):
        import regex
        import tiktoken

        self.enc = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.one = self.enc._core_bpe.encode_single_piece
        self.pattern = regex.compile(pattern)
        self.leaf, self.match_leaf = max(2, leaf), max(2, match_leaf)

    # -- encoding -------------------------------------------------------------
    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, s: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self._plain(s[lo:hi])
        mid = (lo + hi) // 2
        return self._join(s, lo, mid, hi, self._encode(s, lo, mid), self._encode(s, mid, hi))

    def _plain(self, text: str) -> list[int]:
        """A leaf or window: the library, or for a long match the byte tree."""
        if len(text) <= 2 * self.leaf:
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            out += self.encode_match(m.group().encode("utf-8", "surrogatepass"))
        return out

    def _join(self, s: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        if _starts(s, mid):
            return left + right
        a, b, reach = None, None, 32
        while a is None or b is None:
            if a is None:
                low = max(lo, mid - reach)
                a = next((p for p in range(mid - 1, low, -1) if _starts(s, p)), lo if low == lo else None)
            if b is None:
                high = min(hi, mid + reach)
                b = next((p for p in range(mid + 1, high) if _starts(s, p)), hi if high == hi else None)
            reach *= 2
        keep_l = len(left) - len(self._plain(s[a:mid])) if a > lo else 0
        keep_r = len(self._plain(s[mid:b])) if b < hi else len(right)
        return left[:keep_l] + self._plain(s[a:b]) + right[keep_r:]

    def encode_match(self, b: bytes) -> list[int]:
        if len(b) <= self.match_leaf:
            return self.one(b)
        mid = len(b) // 2
        return self._join_match(self.encode_match(b[:mid]), self.encode_match(b[mid:]))

    def _fits(self, x: int, y: int) -> bool:
        return self.one(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def _join_match(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self._fits(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.one(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._fits(left[i - 1], window[0])) and (j == len(right) or self._fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    # -- decoding -------------------------------------------------------------
    def decode(self, ids: list[int]) -> bytes:
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids: list[int], lo: int, hi: int) -> bytes:
        if hi - lo <= 4 * self.leaf:
            return self.enc.decode_bytes(ids[lo:hi])
        mid = (lo + hi) // 2
        return self._decode(ids, lo, mid) + self._decode(ids, mid, hi)


def _starts(s: str, p: int) -> bool:
    """Whether a match starts at p for certain: white space after other text."""
    return 0 < p < len(s) and s[p] in " \n" and not s[p - 1].isspace()


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, ids array<int>, decoded binary)`` per row of ``docs``.

    Null text counts as empty and gives no ids. Repeated rows and null ``doc_id``
    stay as they are; other columns are ignored.
    """

    def make():
        bpe = TreeBPE(load_ranks(ranks_path), pattern, leaf)

        def rows(cols):
            for d, t in zip(*cols, strict=True):
                ids = bpe.encode(t or "")
                yield d, ids, bpe.decode(ids)

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, ids array<int>, decoded binary", make)


def digests(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: :func:`encode_documents`
    with the sums taken in the worker, so that ids needn't travel. An empty table
    gives no rows."""

    def make():
        bpe = TreeBPE(load_ranks(ranks_path), pattern, leaf)

        def rows(cols):
            for d, t in zip(*cols, strict=True):
                ids = bpe.encode(t or "")
                yield d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
