"""Fill-in-the-middle: texts cut in three at unit boundaries and rewritten as prefix-suffix-middle or suffix-prefix-middle.

Cut points come from an overlapping-chunk decomposition. All texts of a block are cut into chunks of CHUNK bytes, each
reading one byte of the next, so that whether a unit ends at a character depends on that character and the one after it
alone. Boundaries are counted for all chunks at once; prefix sums over the chunks of a text give its number of units and
route the ranks of both cuts to the chunks that own them; only those are scanned again for the place.

One pass without a shuffle: a text's chunks stay in the task that reads it, as counting costs less than sending them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship
from .media import _slices

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

CHUNK = 4096
#: Bytes of text that are worked on at a time; a longer text is alone.
BLOCK = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Whether a unit ends at a byte, given it and the next one. A text's last byte always ends one.
UNITS = {
    "line": lambda here, after: here == 10,
    "word": lambda here, after: ~_SPACE[here] & _SPACE[after],
    "char": lambda here, after: (after & 0xC0) != 0x80,
}
_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _ends(data: np.ndarray, low: int, high: int, stop: int, unit: str) -> np.ndarray:
    """Places in data[low:high], a chunk of a text that stops at `stop`, where a unit ends."""
    ends = UNITS[unit](data[low:high], data[low + 1 : high + 1])
    if high == stop:
        ends[-1] = True
    return np.flatnonzero(ends) + low


class Chunks:
    """Boundary counts of texts in one buffer; `edge` are the places between texts. The buffer has a byte more, for the last overlap."""

    def __init__(self, data: np.ndarray, edge: np.ndarray, unit: str, chunk: int = CHUNK) -> None:
        self.data, self.edge, self.unit = data, edge, unit
        size = np.diff(edge)
        parts = -(-size // chunk)
        self.first = np.append(0, np.cumsum(parts))
        nth = np.arange(self.first[-1]) - np.repeat(self.first[:-1], parts)
        self.low = np.repeat(edge[:-1], parts) + nth * chunk
        self.stop = np.repeat(edge[1:], parts)
        self.high = np.minimum(self.low + chunk, self.stop)
        counts = np.zeros(0, np.int64)
        if len(self.low):
            ends = UNITS[unit](data[:-1], data[1:])
            ends[edge[1:][size > 0] - 1] = True
            counts = np.add.reduceat(ends.view(np.int8), self.low, dtype=np.int64)
        self.before = np.append(0, np.cumsum(counts))
        self.n = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def place(self, text: int, rank: int) -> int:
        """Where the first `rank` units of a text end."""
        if rank == 0:
            return int(self.edge[text])
        want = int(self.before[self.first[text]]) + rank
        own = int(np.searchsorted(self.before, want, "left")) - 1
        ends = _ends(self.data, int(self.low[own]), int(self.high[own]), int(self.stop[own]), self.unit)
        return int(ends[want - int(self.before[own]) - 1]) + 1


def _draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document; a null doc_id counts as an empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _transform(batches: Iterator[pa.RecordBatch], unit: str, rate: int, spm: int, seed: int) -> Iterator[pa.RecordBatch]:
    marks = [m.encode() for m in MARKS]
    for batch in _slices(batches, "text", BLOCK):
        texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
        edge = np.append(0, np.cumsum([len(x) for x in texts]))
        chunks = Chunks(np.frombuffer(b"".join([*texts, b"\0"]), np.uint8), edge, unit)
        rows: list[tuple] = []
        for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, strict=True)):
            n, (h1, h2, h3, h4) = int(chunks.n[k]), _draws(seed, doc_id)
            if not text or h3 % 100 >= rate or any(m in text for m in marks):
                rows.append((doc_id, n, "plain", None, None, text))
                continue
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            at, to = (chunks.place(k, r) - int(edge[k]) for r in (a, b))
            prefix, middle, suffix = text[:at], text[at:to], text[to:]
            form = "spm" if h4 % 100 < spm else "psm"
            parts = (marks[0], prefix, marks[1], suffix) if form == "psm" else (marks[1], suffix, marks[0], prefix)
            rows.append((doc_id, n, form, len(prefix.decode()), len(middle.decode()), b"".join((*parts, marks[2], middle))))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        columns[-1] = columns[-1].cast(pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """docs(doc_id long, text string, ...) -> doc_id, n (units), form, prefix_chars, middle_chars, output.

    unit: line, word (with the white space before it) or char; rate: per cent of texts that are rewritten; spm: per cent
    of those with the suffix first. Null text: empty. Empty texts and texts that hold a mark stay plain, with null
    lengths. A text of any length is cut whole. Repeated rows give equal rows; a null doc_id stays null and draws as an
    empty id. Other columns are not read. An empty table gives no row.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r}")
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_transform, unit=unit, rate=rate, spm=spm, seed=seed), _DDL)


def restored(output: Column, form: Column) -> Column:
    """The text that `output` was made from. Marks are nowhere else in a rewritten text: no text that holds one is rewritten, and none overlaps itself or another."""
    part = F.split(output, "|".join(MARKS))
    first, second, middle = F.get(part, F.lit(1)), F.get(part, F.lit(2)), F.get(part, F.lit(3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b, ('0x' || h[25:32])::BIGINT % 100 < 50 AS s,
  text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS p FROM d),
c AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS x, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS y FROM r)
SELECT doc_id, n::BIGINT AS n, CASE WHEN p THEN 'plain' WHEN s THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT p THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN NOT p THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE WHEN p THEN text WHEN s THEN '<S>' || y || '<P>' || x || '<M>' || m ELSE '<P>' || x || '<S>' || y || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""
