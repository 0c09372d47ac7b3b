"""Secret scans with multipart credential linking.

Base kinds are strong on their own: an assignment to a secret-like name, an access
key id and a long run of hex digits. Weak candidates are parts of a credential: an
identifier (``id``), a secret-looking string (``part``) and an ``endpoint``. A part
alone proves nothing, so an interval join links parts of one document that share a
scope (a reach of characters around each) and don't overlap; a weak candidate is
reported only where a secret-like part, weak or strong, meets an identifier or an
endpoint. Not every strong one vouches: a plain lower-case word isn't taken for an
assigned secret, and hex digits (a checksum, a commit) say nothing about an address
near them, unless it names a user. Words joined by slashes or hyphens (paths, slugs)
and what lies in an endpoint are no parts.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from trackloom.llm.arrowio import map_rows, sliced
from trackloom.plans.runtime import ship

KINDS = ("assign", "access", "hex", "id", "part", "endpoint")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ finds them
_ID = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
_PART = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
_ENDPOINT = re.compile(r"""\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", re.I | re.A)
_USER = re.compile(r"://[^/\s@]+@")
_PLAIN = re.compile(r"[a-z]+[.,]?|[A-Z][a-z]+[.,]?")
NAMES = {"access", "id", "endpoint"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of the base kinds, failing ones dropped."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _random_looking(s: str) -> bool:
    """Enough bits a character, letters and digits, and kinds of character (upper,
    lower, digit) that change as often as in random strings, unlike in words."""
    n = len(s)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(s).values())
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "" for c in s]
    turns = sum(bool(a and b and a != b) for a, b in pairwise(kinds))
    return bits >= 3.5 and "d" in kinds and ("u" in kinds or "l" in kinds) and turns >= 0.3 * (n - 1)


def weak_parts(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = [(m.start(1), m.end(1), "id") for m in _ID.finditer(text)] if ("=" in text or ":" in text) else []
    ends = [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)] if "://" in text else []
    parts = [(m.start(), m.end(), "part") for m in _PART.finditer(text) if _random_looking(m.group())]
    return [p for p in out + ends + _apart(parts, ends) if _apart([p], base)]


def _apart(spans: list[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of ``others`` (in order of their starts)."""
    starts, top = [o[0] for o in others], 0
    reach = [top := max(top, o[1]) for o in others]
    return [p for p in spans if not ((i := bisect.bisect_left(starts, p[1])) and reach[i - 1] > p[0])]


def vouching(text: str, base: list[tuple[int, int, str]], kind: str) -> list[tuple[int, int, str]]:
    """The base spans that speak for a weak candidate of ``kind``: names for a part; for
    an id or an endpoint what was assigned (unless a plain word), hex digits for an id
    or (``user``) an endpoint that names its user."""
    if kind == "part":
        return [s for s in base if s[2] == "access"]
    assigned = [s for s in base if s[2] == "assign" and not _PLAIN.fullmatch(_ASSIGN.match(text, s[0]).group(2))]
    return assigned + ([s for s in base if s[2] == "hex"] if kind != "endpoint" else [])


def link(text: str, base: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """Interval join by sorted bounds: the weak spans that have a complementary span
    before or after them, not overlapping, at most ``scope`` characters away."""
    found = []
    for kind in sorted({w[2] for w in weak}):
        mine = [w for w in weak if w[2] == kind]
        other = [w for w in weak if (w[2] == "part") != (kind == "part")]
        named = [w for w in mine if kind == "endpoint" and _USER.search(text, w[0], w[1])]
        plain = [w for w in mine if w not in named]
        for group, rule in ((plain, kind), (named, "user")):
            facing = [*vouching(text, base, rule), *other] if group else []
            starts, ends = sorted(s[0] for s in facing), sorted(s[1] for s in facing)
            for w in group:
                i, j = bisect.bisect_left(starts, w[1]), bisect.bisect_right(ends, w[0])
                if (i < len(starts) and starts[i] <= w[1] + scope) or (j and ends[j - 1] >= w[0] - scope):
                    found.append(w)
    return found


def scan(text: str | None, scope: int = 200) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), ordered by start and kind."""
    text = text or ""
    base = base_spans(text)
    extra = link(text, base, weak_parts(text, base), scope)
    return base, sorted([*base, *extra], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_documents(docs: DataFrame, scope: int = 200) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` per row.

    Offsets are code points, ends exclusive. Null text counts as empty; repeated
    rows and null ``doc_id`` stay; other columns are ignored; an empty table gives
    no rows.
    """

    def make():
        def rows(cols):
            for d, t in zip(*cols, strict=True):
                base, every = scan(t, scope)
                n = Counter(k for _, _, k in base)
                yield d, n["assign"], n["access"], n["hex"], hashlib.sha256(render(base).encode()).hexdigest(), render(every)

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)


def redact(text: str | None, scope: int = 200) -> str | None:
    """The text with every reported span replaced by ``[kind]``."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in scan(text, scope)[1]:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, scope: int = 200) -> DataFrame:
    """The rows of ``docs`` with reported secrets replaced in ``text``; ``n_chars``,
    where present, follows. Other columns pass through; null text and null ids stay
    null; repeated rows are treated alike; an empty table gives no rows."""
    spark, names = docs.sparkSession, docs.columns
    ship(spark)

    def run(batches):
        for batch in sliced(batches):
            cols = list(batch.columns)
            texts = [redact(t, scope) for t in batch.column(names.index("text")).to_pylist()]
            for name, values in (("text", texts), ("n_chars", [None if t is None else len(t) for t in texts])):
                if name in names:
                    i = names.index(name)
                    cols[i] = pa.array(values, type=cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names with dots don't go through
    return plain.mapInArrow(run, plain.schema).toDF(*names)
