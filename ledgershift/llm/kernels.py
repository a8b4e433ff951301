"""Vectorised hashing of the words of many texts at once (numpy over Arrow's character buffers)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_LONG_WORD = 256
_PART = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known public hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLE = np.frombuffer(np.random.default_rng(20240607).bytes(256 * 8), "<u8").copy()
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POW = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POW[0]) < n:
        size = max(n, 1 << 20)
        _POW[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 2**64), size)]
    return _POW[0][:n], _POW[1][:n]


@dataclass
class Words:
    """Words of a block of texts: hash, and for text i the words first[i]:first[i + 1]; starts and ends in the block's bytes."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of texts data[offsets[i]:offsets[i + 1]] (UTF-8), each with a 64-bit hash.

    A polynomial over the bytes by one running sum; words of over 256 bytes take xxh3, as a polynomial modulo 2**64
    has known weak long inputs. lower: A-Z count as a-z.
    """
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    offsets = offsets - base
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = inside[1:] != inside[:-1]
    starts_text = np.zeros(n + 1, bool)
    starts_text[offsets] = True
    begin = np.flatnonzero(inside[1:] & (edge | starts_text))
    stop = np.flatnonzero(inside[:-1] & (edge | starts_text))
    table = _LOWER if lower else _TABLE
    h = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):  # some words at a time: eight bytes a character are held for these only
        at = begin[i]
        j = max(i + 1, int(np.searchsorted(stop, at + _PART, "right")))
        span = int(stop[j - 1] - at)
        power, inverse = _pow(span + 1)
        total = np.zeros(span + 1, np.uint64)
        np.cumsum(table[data[at : at + span]] * power[:span], out=total[1:])
        h[i:j] = (total[stop[i:j] - at] - total[begin[i:j] - at]) * inverse[begin[i:j] - at]
        i = j
    size = (stop - begin).astype(np.uint64)
    h = mix(h + size * _M1)
    for i in np.flatnonzero(size > _LONG_WORD):
        word = data[begin[i] : stop[i]].tobytes()
        h[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    return Words(h, np.searchsorted(begin, offsets), begin, stop)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive values of h; those across texts are for the caller to leave out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    power, inverse = _pow(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: len(h) - k + 1])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 4 << 20, rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Cut and join batches into blocks of about `size` bytes of text and `rows` rows at most; a longer text is a block alone.

    Only the order of rows matters, not Arrow's batch limits, so a rerun of the task makes the same blocks.
    """
    held: list[pa.RecordBatch] = []
    held_bytes = held_rows = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            room = max(0, size - held_bytes)
            end = int(np.searchsorted(offsets, offsets[at] + room, "right")) - 1
            end = min(batch.num_rows, at + rows - held_rows, max(end, at))
            if end == at and not held:
                end = at + 1
            if end > at:
                held.append(batch.slice(at, end - at))
                held_bytes += int(offsets[end] - offsets[at])
                held_rows += end - at
                at = end
            if held and (held_bytes >= size or held_rows >= rows or at < batch.num_rows):
                yield joined()
                held, held_bytes, held_rows = [], 0, 0
    if held:
        yield joined()
