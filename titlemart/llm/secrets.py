"""Secret scan with linking of multipart credentials.

Strong findings stand alone: assignments (``password = ...``), access identifiers (``AKIA...``) and long hexadecimal
runs.  The parts of a multipart credential are weak alone: a 40-character base64-like string may be a secret key or a
checksum, and a URL is an endpoint of something or nothing.  So access identifiers, secrets and endpoints are joined as
intervals: parts within ``scope`` code points of each other, in one paragraph (no blank line between), form one
credential.  A weak secret or endpoint is reported only if an access identifier, and for an endpoint also a
secret, lies in its scope.

Scopes never cross documents, so a document's parts are joined where its text is read: they are few, sorted by
position and found by bisection, and nothing is shuffled.  Each task holds one Arrow batch of texts.

Defined cases: null text is empty; doc_id may be null or repeat, each row is scanned by itself; ties (parts at equal
distance) link to the earlier part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

#: The base patterns, their shortest lengths, and the patterns of weak parts.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the run itself, so this equals + with a length test
# An equals sign before is an assignment's; after, it may pad the run but not lead to a value.
SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?!={0,2}[A-Za-z0-9+/]|={3})")
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "secret", "endpoint")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX_MARK = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = b"\x01" * 16

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Strong findings, by start and kind.  Cheap byte searches decide which patterns have to run at all."""
    raw = text.encode("utf-8", "surrogatepass")
    found: list[Span] = []
    low = raw.translate(_LOWER)
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if _HEX_RUN in raw.translate(_HEX_MARK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _gap(a: Span, b: Span) -> int:
    return max(b[0] - a[2], a[0] - b[2], 0)


class Parts:
    """Parts of one kind, by start; they may overlap and lie inside one another."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted(spans)
        self.furthest = list(accumulate((s[2] for s in self.spans), max))  # the greatest end so far

    def near(self, part: Span, scope: int, breaks: list[int]) -> Span | None:
        """The part nearest to ``part`` in its scope: of those that begin before it the first to end latest, or the first that begins with it or after."""
        i = bisect_left(self.spans, part)
        found = []
        if i:
            found.append(self.spans[bisect_left(self.furthest, min(self.furthest[i - 1], part[0]))])
        found += self.spans[i : i + 1]
        best = None
        for x in found:
            lo, hi = min(part[2], x[2]), max(part[0], x[0])
            if (gap := _gap(part, x)) <= scope and bisect_left(breaks, lo) == bisect_left(breaks, max(hi, lo)):
                if best is None or gap < best[0]:
                    best = (gap, x)
        return best and best[1]


def linked_spans(text: str, base: list[Span], scope: int) -> tuple[list[Span], list[tuple[Span, Span | None, Span | None]]]:
    """Weak parts whose complements co-occur, and the credentials as (access, secret, endpoint)."""
    access = [s for s in base if s[1] == 1]
    if not access:
        return [], []
    breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
    weak = [(m.start(), 3, m.end()) for m in SECRET.finditer(text)]
    assigned = [s for s in base if s[1] == 0]
    endpoints = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)]
    ids = Parts(access)
    added = {s for s in weak if ids.near(s, scope, breaks)}
    # A weak part inside an assignment is the same secret.
    begins = [a[0] for a in assigned]  # assignments don't overlap, so only the last to begin can hold a part
    sure = Parts(assigned + [s for s in added if not (i := bisect_right(begins, s[0])) or assigned[i - 1][2] < s[2]])
    said = Parts([e for e in endpoints if ids.near(e, scope, breaks) and sure.near(e, scope, breaks)])
    added |= set(said.spans)
    links = [(a, sure.near(a, scope, breaks), said.near(a, scope, breaks)) for a in access]
    return sorted(added), [x for x in links if x[1]]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, scope: int = 300) -> DataFrame:
    """One row a document: counts of base findings, all spans and the linked credentials."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "credentials")}
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                more, links = linked_spans(text, base, scope)
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(spelled(base).encode()).hexdigest())
                out["spans"].append(spelled(sorted(base + more)))
                out["credentials"].append([spelled([p for p in link if p]) for link in links])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")]
                + [pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string())]
                + [pa.array(out["credentials"], pa.list_(pa.string()))],
                names=["doc_id", *out],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        of,
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
        "credentials array<string>",
    )
