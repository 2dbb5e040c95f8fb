"""Secret scans with multipart credential linking.

Strong spans (assignments, access keys, long hexadecimal runs) stand alone.  Weak ones (other identifiers, bare random
strings, endpoints) are reported only where a complementary part lies within the same scope, so the parts of a
document are joined by intervals.  A scope never leaves its document: the join is done on the row's own sorted
positions, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tachado.llm.tables import pieces

#: Fixed by the format of the result: kinds in the order in which spans of equal start are listed.
KINDS = ["assign", "access", "hex", "key_id", "bare", "endpoint"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY_ID = re.compile(r"\bA(?:3T|BIA|CCA|GPA|IDA|IPA|NPA|NVA|ROA|SIA)[A-Z0-9]{12,}", re.A)
NAMED_ID = re.compile(r"\b(?:client_?id|access_?key_?id|account_?id|user_?name|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,}", re.I | re.A)
#: Also right after "=", as in NAME=VALUE; after the value, "=" is padding.
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]+")
ROLE = {"assign": "secret", "hex": "secret", "bare": "secret", "access": "id", "key_id": "id", "endpoint": "endpoint"}
COMPLEMENT = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
SCOPE = 300
LONG = re.compile(r"[A-Za-z0-9+/_-]{24}")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Strong spans (start, end, kind): leftmost, non-overlapping for each kind, in the listed order."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def weak_spans(text: str) -> list[Span]:
    """Parts of a credential that mean nothing alone."""
    found = []
    found += [(*m.span(), "key_id") for m in KEY_ID.finditer(text)]
    if ":" in text or "=" in text:
        found += [(*m.span(), "key_id") for m in NAMED_ID.finditer(text)]
    if LONG.search(text):
        found += [(*m.span(), "bare") for m in BARE.finditer(text)]
    if "://" in text:
        found += [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)]
    return found


def link(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """Of ``weak``, those with a complementary part of either list within ``scope`` characters, outside of base spans."""
    taken = {kind: sorted(s for s in base if s[2] == kind) for kind in KINDS[:3]}

    def inside(s: Span) -> bool:  # spans of a kind do not overlap, so the last that begins before the end of s decides
        return any((k := bisect_left(of, (s[1], 0, ""))) and of[k - 1][1] > s[0] for of in taken.values())

    open_ = [s for s in weak if not inside(s)]
    places: dict[str, list[tuple[int, int]]] = {}
    for s in sorted([*base, *open_]):
        places.setdefault(ROLE[s[2]], []).append(s[:2])
    reach = {role: max(e - b for b, e in at) for role, at in places.items()}

    def near(s: Span, role: str) -> bool:
        at = places.get(role, [])
        k = bisect_left(at, (s[0] - scope - reach.get(role, 0), 0))
        while k < len(at) and at[k][0] <= s[1] + scope:
            if at[k][1] >= s[0] - scope:
                return True
            k += 1
        return False

    return [s for s in open_ if any(near(s, role) for role in COMPLEMENT[ROLE[s[2]]])]


def spans_of(text: str | None, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """Strong spans, and all spans in the listed order."""
    base = base_spans(text or "")
    weak = weak_spans(text or "")
    return base, sorted([*base, *link(base, weak, scope)], key=_order) if weak else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    ``found`` has (kind, start, end, value) of all spans, in code points, end exclusive; ``spans`` the same as text.
    A null text is empty and has none; repeated rows are scanned each; other columns are ignored.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                both = [spans_of(t, scope) for t in texts]
                count = {k: [sum(s[2] == k for s in base) for base, _ in both] for k in KINDS[:3]}
                found = [[{"kind": k, "start": b, "end": e, "value": t[b:e]} for b, e, k in every] for t, (_, every) in zip(texts, both)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *(pa.array(count[k], pa.int64()) for k in KINDS[:3]),
                    pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in both]),
                    pa.array([listed(every) for _, every in both], pa.string()),
                    pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(rows, (
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
        "found array<struct<kind:string,start:bigint,end:bigint,value:string>>"))


def masked(text: str, scope: int = SCOPE) -> str:
    """``text`` with each run of overlapping spans replaced by one mark that names the first kind."""
    out, at = [], 0
    for begin, end, kind in spans_of(text, scope)[1]:
        if begin >= at:
            out += [text[at:begin], f"[SECRET {kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked; every other column as it was, and null texts stay null."""
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [t if t is None else masked(t, scope) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)

    return docs.mapInArrow(rows, docs.schema)
