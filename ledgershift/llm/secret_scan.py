"""Secret scans: fixed patterns, and strings whose sliding windows have a high Shannon entropy for their character class.

Candidates are the longest runs of a class's characters that hold a window. A window slides over each; the counts of its
characters and the sum of c * log2(c) change by the character that leaves and the one that enters, for all candidates of
a block of texts at once. Sums are whole numbers (2**-20 bits), so that a window's verdict does not depend on the order
of additions. Windows that reach the class's entropy and hold its kinds of characters are joined to spans; a span goes
if an allow-list pattern matches its candidate, or a span of a fixed pattern holds all of it.

One pass without a shuffle. A long candidate is cut into SEGMENT windows at a time, which overlap by a window less one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .media import _slices

# The base patterns, whose letters match in either case in `assign`, and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharClass:
    """A kind of span: its characters, the window, the least bits a character, and what a window must hold (digit, lower, upper)."""

    kind: str
    chars: str
    window: int
    bits: float
    holds: tuple[str, ...]


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 2.75, ("0-9", "A-Fa-f")),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", 20, 3.5, ("0-9", "a-z", "A-Z")),
)
KINDS = BASE + tuple(c.kind for c in CLASSES)
#: What a candidate may be without being a secret: identifiers, alphabets in order, examples, paths, digests of packages.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"[Ee]xample|EXAMPLE|[Ss]ample|SAMPLE|[Dd]ummy|DUMMY|[Pp]laceholder|PLACEHOLDER|[Cc]hange_?me|CHANGE_?ME|xxxxx|XXXXX",
    r"(^|/)[a-z]+/[a-z_-]+/",
    r"^sha(1|256|384|512)-",
)

#: Units of a bit; windows of a segment; bytes of text worked on at a time.
UNIT = 1 << 20
SEGMENT = 256
BLOCK = 1 << 22
_DDL = "doc_id long, spans array<struct<kind string, start long, end long>>"


def weights(window: int) -> np.ndarray:
    """c * log2(c) for c = 0 to window, in units."""
    return np.array([0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))], np.int64)


def limit(c: CharClass) -> int:
    """The largest sum of weights of a window that reaches the class's bits: entropy = log2(window) - sum / window."""
    return math.floor((c.window * math.log2(c.window) - c.window * c.bits) * UNIT)


def _members(chars: str) -> np.ndarray:
    return np.array([bool(re.fullmatch(f"[{chars}]", chr(b))) if b < 128 else False for b in range(256)])


class Windows:
    """Finds the windows of a class that reach its entropy."""

    def __init__(self, c: CharClass) -> None:
        self.c, self.weight, self.limit = c, weights(c.window), limit(c)
        self.run = re.compile(f"[{c.chars}]{{{c.window},}}".encode())
        own = np.flatnonzero(_members(c.chars))
        self.code = np.zeros(256, np.int64)
        self.code[own] = np.arange(len(own))
        self.size = len(own)
        self.holds = np.array([_members(x) for x in c.holds])

    def hits(self, candidates: list[bytes]) -> list[np.ndarray]:
        """For each candidate, whether each of its windows reaches the entropy and holds what it must."""
        w = self.c.window
        length = np.array([len(x) for x in candidates], np.int64)
        edge = np.append(0, np.cumsum(length))
        data = np.frombuffer(b"".join(candidates), np.uint8)
        out = np.zeros(len(data), bool)  # by the window's first place
        windows = length - w + 1
        parts = -(-windows // SEGMENT)
        nth = np.arange(parts.sum()) - np.repeat(np.append(0, np.cumsum(parts))[:-1], parts)
        start = np.repeat(edge[:-1], parts) + nth * SEGMENT
        steps = np.minimum(np.repeat(windows, parts) - nth * SEGMENT, SEGMENT)
        order = np.argsort(-steps, kind="stable")
        start, steps = start[order], steps[order]
        code, holds = self.code[data], self.holds[:, data].astype(np.int16)
        m = len(start)
        rows, counts, total = np.arange(m), np.zeros((m, self.size), np.int16), np.zeros(m, np.int64)
        held = np.zeros((len(self.holds), m), np.int16)

        def change(n: int, at: np.ndarray, by: int) -> None:
            one, c = rows[:n], code[at]
            had = counts[one, c]
            counts[one, c] = had + by
            total[:n] += self.weight[had + by] - self.weight[had]
            held[:, :n] += by * holds[:, at]

        for t in range(w):
            change(m, start + t, 1)
        n = m
        for t in range(int(steps[0]) if m else 0):
            if t:
                n = int(np.searchsorted(-steps, -t, "left"))  # segments with more than t windows
                change(n, start[:n] + t - 1, -1)
                change(n, start[:n] + t + w - 1, 1)
            out[start[:n] + t] = (total[:n] <= self.limit) & (held[:, :n] > 0).all(axis=0)
        return [out[a : a + k] for a, k in zip(edge[:-1].tolist(), windows.tolist(), strict=True)]


def _joined(hits: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The spans that windows beginning at `hits` cover; windows that touch are one."""
    at = np.flatnonzero(hits)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(x[0]), int(x[-1]) + window) for x in np.split(at, cut)]


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, in bytes."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST_HEX]


def _in_chars(text: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Spans in code points, by start, then kind."""
    if not spans:
        return []
    places = sorted({p for a, _, b in spans for p in (a, b)})
    chars, at, n = {}, 0, 0
    for p in places:
        n += len(text[at:p].decode())
        chars[p], at = n, p
    return [{"kind": KINDS[k], "start": chars[a], "end": chars[b]} for a, k, b in sorted(spans)]


def _scan(batches: Iterator[pa.RecordBatch], allowed: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    allow = re.compile("|".join(f"(?:{x})" for x in allowed).encode()) if allowed else None
    classes = [Windows(c) for c in CLASSES]
    for batch in _slices(batches, "text", BLOCK):
        texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
        spans = [base_spans(x) for x in texts]
        base = [list(x) for x in spans]
        for k, c in enumerate(classes, len(BASE)):
            found = [(i, m.start(), m[0]) for i, x in enumerate(texts) for m in c.run.finditer(x) if not (allow and allow.search(m[0]))]
            for (i, at, _), hits in zip(found, c.hits([x for _, _, x in found]) if found else (), strict=True):
                for a, b in _joined(hits, c.c.window):
                    if not any(x <= at + a and at + b <= y for x, _, y in base[i]):
                        spans[i].append((at + a, k, at + b))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_in_chars(x, s) for x, s in zip(texts, spans, strict=True)], kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, spans array<struct<kind, start, end>> in code points, by start, then kind.

    Null or empty text: no span. A text of any length is scanned whole. Repeated rows give equal rows; a null doc_id stays
    null. Other columns are not read. An empty table gives no row. allowed: patterns that excuse a candidate of the
    entropy classes; spans of the fixed patterns always stay.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scan, allowed=allowed), _DDL)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined) of find_secrets()."""
    found = find_secrets(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _sql() -> str:
    assign = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [("assign", assign), ("access", f"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"), ("hex", f"[0-9a-f]{{{LEAST_HEX},}}"), *((c.kind, f"[{c.chars}]{{{c.window},}}") for c in CLASSES)]
    found = " UNION ALL ".join(f"SELECT k, doc_id, '{kind}' AS kind, {n} AS o, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d" for n, (kind, p) in enumerate(patterns))
    value = f"length(regexp_extract(s, '{assign}', 2)) >= {LEAST_ASSIGN}"
    allow = "|".join(f"({x})" for x in ALLOWED)
    tests = " OR ".join(
        f"(kind = '{c.kind}' AND total <= {limit(c)} AND " + " AND ".join(f"regexp_matches(x, '[{h}]')" for h in c.holds) + ")" for c in CLASSES
    )
    weight = "[" + ", ".join(map(str, weights(max(c.window for c in CLASSES)).tolist())) + "]"
    window = "CASE kind " + " ".join(f"WHEN '{c.kind}' THEN {c.window}" for c in CLASSES) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
u AS (SELECT k, kind, o, unnest(m) AS s, unnest(list_transform(range(1, 1 + len(m)), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)))::BIGINT AS a FROM f WHERE len(m) > 0),
b AS (SELECT k, kind, o, s, a, a + length(s) AS z FROM u WHERE kind <> 'assign' OR {value}),
c AS (SELECT k, kind, o, s, a, {window} AS w FROM b WHERE kind NOT IN ('assign', 'access', 'hex') AND NOT regexp_matches(s, '{allow}')),
i AS (SELECT k, kind, o, a, w, unnest(range(a, a + length(s) - w + 1)) AS p, s FROM c),
x AS (SELECT k, kind, o, a, w, p, s[p - a + 1:p - a + w] AS x FROM i),
y AS (SELECT k, kind, o, a, w, p, x, list_sum(list_transform(map_values(h), lambda n: ({weight})[n::INTEGER + 1])) AS total FROM (SELECT *, list_histogram(string_split(x, '')) AS h FROM x)),
t AS (SELECT k, kind, o, a, w, p, CASE WHEN p - lag(p) OVER (PARTITION BY k, kind, a ORDER BY p) <= w THEN 0 ELSE 1 END AS new FROM y WHERE {tests}),
v AS (SELECT k, kind, o, min(p) AS a, max(p) + any_value(w) AS z FROM (SELECT *, sum(new) OVER (PARTITION BY k, kind, a ORDER BY p) AS part FROM t) GROUP BY k, kind, o, a, part),
e AS (SELECT k, kind, o, a, z FROM b WHERE kind IN ('assign', 'access', 'hex')),
n AS (SELECT * FROM e UNION ALL SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k = v.k AND e.a <= v.a AND v.z <= e.z))
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o) FILTER (o < 3), '')) AS base_sha256, coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, o, z) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN n USING (k) GROUP BY k
"""


ORACLE = _sql()
