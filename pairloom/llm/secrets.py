"""Secret scan with multipart credential linking.

Base kinds are reported wherever they occur: ``assign`` (a named value, the span of the
value), ``access`` (access identifiers) and ``hex`` (long hexadecimal runs). On their own,
other parts prove nothing: a secret-like run of 32 characters or more, or a host of a service. Each
scope of a text, the ``SCOPE`` code points around a candidate, is searched for the
complementary part: a weak secret counts when an access identifier or an endpoint lies in
its scope, an endpoint when it lies near an access identifier or a named value. The
complementary parts, widened by the scope, are merged into disjoint intervals and searched by
bisection, so no pair of parts is ever listed and the length of a part widens no scope.

Defined cases: null is the empty text; no finding is zero counts and empty strings; texts
are scanned whole, whatever their length; repeated rows are scanned and reported each; input columns with the name
of a new one are left out, others are kept.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import decoded, with_arrow_columns

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run that is too short holds no run that is long enough
ASSIGN_STEMS = ("passw", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{32,}")
# Part of a run: a name ends at "=", which belongs to a part only as padding at the end of the run.
WEAK = re.compile(r"[A-Za-z0-9+/_-]{32,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
WHOLE = 64  # a run of several short parts counts as one up to this length
ENDPOINT = re.compile(r"(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+", re.A)
SCOPE = 400
KINDS = ("assign", "access", "hex", "secret", "endpoint")  # in the order of ties
BASE = 3
FIELDS = (
    "findings array<struct<kind:string,start:int,stop:int>>, n_assign long, n_access long, n_hex long, "
    "base_sha256 string, spans string"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the base kinds, sorted."""
    found = []
    low = text.lower()
    if any(stem in low for stem in ASSIGN_STEMS) or "K" in text or "ſ" in text:
        found += [(m.start(2), 0, m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Cover:
    """Disjoint sorted intervals that cover ``spans`` widened by ``by`` on both sides."""

    def __init__(self, spans: list[tuple[int, int]], by: int = 0):
        self.starts, self.stops = [], []
        for start, stop in sorted(spans):
            if self.stops and start - by <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop + by)
            else:
                self.starts.append(start - by)
                self.stops.append(stop + by)

    def reaches(self, start: int, stop: int) -> bool:
        """Whether an interval holds a place from ``start`` to ``stop``, borders included."""
        at = bisect_right(self.starts, stop) - 1
        return at >= 0 and self.stops[at] >= start


def _mixed(run: str) -> bool:
    """Letters of both cases and digits: not a word, a number or a ruled line."""
    return any(c.isdigit() for c in run) and any("a" <= c <= "z" for c in run) and any("A" <= c <= "Z" for c in run)


def weak_spans(text: str) -> list[tuple[int, int]]:
    """Secret-like runs of 32 characters and more, without the name in front of them."""
    found = []
    for run in RUN.finditer(text):
        parts = [m.span() for m in WEAK.finditer(text, *run.span()) if _mixed(m.group())]
        if not parts and run.end() - run.start() <= WHOLE and _mixed(run.group()):
            parts = [run.span()]
        found += parts
    return found


def scan(text: str) -> list[tuple[int, int, int]]:
    """Base spans and the weak candidates whose complementary part is in scope."""
    base = base_spans(text)
    endpoints = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    access = [(s, e) for s, kind, e in base if kind == 1]
    if not endpoints and not access:
        return base
    taken = Cover([(s, e) for s, _, e in base] + endpoints)
    anchors = Cover(access + endpoints, SCOPE)
    # Spans that only touch do not overlap.
    weak = [(s, e) for s, e in weak_spans(text) if not taken.reaches(s + 1, e - 1) and anchors.reaches(s, e)]
    keyed = Cover([(s, e) for s, kind, e in base if kind != 2] + weak, SCOPE)
    linked = [(s, e) for s, e in endpoints if keyed.reaches(s, e)]
    return sorted(base + [(s, 3, e) for s, e in weak] + [(s, 4, e) for s, e in linked])


def _listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in found)


def find_secrets(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the findings of each row (code points, end exclusive) and their digests."""

    def compute(texts: list[bytes]) -> list:
        columns: list[list] = [[] for _ in range(6)]
        for raw in texts:
            found = scan(decoded(raw))
            base = [f for f in found if f[1] < BASE]
            row = [
                [{"kind": KINDS[kind], "start": start, "stop": stop} for start, kind, stop in found],
                *(sum(f[1] == kind for f in base) for kind in range(BASE)),
                hashlib.sha256(_listed(base).encode()).hexdigest(),
                _listed(found),
            ]
            for column, value in zip(columns, row):
                column.append(value)
        return columns

    return with_arrow_columns(df, text, FIELDS, compute, drop=() if keep_text else (text,))


def mask(text: str) -> str:
    """``text`` with every finding replaced by its kind; overlapping findings become one."""
    parts, at = [], 0
    for start, kind, stop in scan(text):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


def mask_secrets(df: DataFrame, text: str = "text", chars: str | None = None) -> DataFrame:
    """``df`` in its columns with secrets masked; null stays null. ``chars`` names a column
    that holds the text's length and follows it where a text changed."""
    order = df.columns

    def compute(texts: list[bytes]) -> list:
        return [[None if t is None else mask(decoded(t)) for t in texts]]

    kind = dict(df.dtypes)[text]
    if chars is None or chars not in order:
        return with_arrow_columns(df, text, f"`{text}` {kind}", compute).select(*(f"`{c}`" for c in order))
    changed = with_arrow_columns(
        df.withColumn("_chars_before", F.length(text)), text, f"`{text}` {kind}", compute
    )
    shift = F.length(text) - F.col("_chars_before")
    return changed.withColumn(chars, (F.col(chars) + F.coalesce(shift, F.lit(0))).cast(dict(df.dtypes)[chars])).select(*(f"`{c}`" for c in order))
