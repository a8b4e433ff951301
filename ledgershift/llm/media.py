"""Media columns: texts as 8-bit grey PNG pictures 64 samples wide, with a low-frequency cosine-transform hash.

The codec is whole: signature, IHDR, any number of IDAT chunks and IEND, each with its CRC-32; the zlib stream with its
Adler-32; all five row filters, chosen row by row on writing and undone in numpy on reading. Decoding fails on any
checksum that is wrong. Pictures are written to Parquet and read back before features are computed.

Average and Paeth rows depend on the sample to the left and on the row above; runs of such rows of many pictures are
undone together, a diagonal of all of them at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)

WIDTH = 64
CHUNK = 1 << 20
#: Rows and columns of runs that are undone together, about.
_TOGETHER = 1 << 16
#: Side of the picture that is transformed, and of the kept block of low frequencies.
SIDE, LOW = 32, 8


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of left, up and corner (16-bit integers) the one nearest to left + up - corner; ties in that order."""
    a, b = np.abs(up - corner), np.abs(left - corner)
    c = np.abs(left + up - 2 * corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def filtered(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(filter, residues) of each row: the filter with the least sum of absolute residues (signed bytes), ties by number."""
    wide = samples.astype(np.int16)
    left, up, corner = np.zeros_like(wide), np.zeros_like(wide), np.zeros_like(wide)
    left[:, 1:], up[1:], corner[1:, 1:] = wide[:, :-1], wide[:-1], wide[:-1, :-1]
    kinds, rest, least = np.zeros(len(samples), np.uint8), samples.copy(), None
    for kind in (NONE, SUB, UP, AVERAGE, PAETH):
        guess = (0, left, up, (left + up) >> 1, None)[kind] if kind != PAETH else _paeth(left, up, corner)
        some = (wide - guess).astype(np.uint8)
        cost = np.abs(some.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        if least is None:
            least = cost
            continue
        better = cost < least
        kinds[better], rest[better], least = kind, some[better], np.minimum(cost, least)
    return kinds, rest


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """A grey 8-bit PNG of a (height, width) uint8 array, with a filter chosen for each row."""
    height, width = samples.shape
    raw = np.empty((height, width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = filtered(samples)
    data = zlib.compress(raw.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", data[k : k + CHUNK]) for k in range(0, len(data), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray, tops: np.ndarray | None = None) -> np.ndarray:
    """Samples of filtered rows (one byte a sample) of pictures that begin at rows `tops` (one picture, if not given).

    Rows without a filter and those that look left only are done at once. What is left are runs of rows that look up;
    each starts below a known row or at a picture's top. Runs of like lengths go together, a diagonal at a time.
    """
    if len(kinds) and kinds.max() > PAETH:
        raise ValueError(f"row filter {kinds.max()}")
    out, (height, width) = rows.copy(), rows.shape
    sub = kinds == SUB
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    top = np.zeros(height, bool)
    top[np.zeros(1, np.int64) if tops is None else tops] = True
    looks_up = kinds >= UP
    begins = looks_up & (top | ~np.append(False, looks_up[:-1]))
    start = np.flatnonzero(begins)
    if not len(start):
        return out
    ends = ~looks_up | top
    stop = np.append(np.flatnonzero(ends), height)
    size = stop[np.searchsorted(stop, start, "right")] - start
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        longest = int(size[order[a]])
        while b < len(order) and (b - a + 1) * (int(size[order[b]]) + width) <= _TOGETHER:
            longest = int(size[order[b]])
            b += 1
        _undo(out, kinds, top, start[order[a:b]], size[order[a:b]], longest)
        a = b
    return out


def _undo(out: np.ndarray, kinds: np.ndarray, top: np.ndarray, start: np.ndarray, size: np.ndarray, longest: int) -> None:
    """Undo runs of rows start[i]:start[i] + size[i] in `out`; sample x of row y of a run is on its diagonal x + y."""
    width, n = out.shape[1], len(start)
    row = np.minimum(start[:, None] + np.arange(longest), len(out) - 1)
    inside = np.arange(longest) < size[:, None]
    above = np.where(top[start][:, None], 0, out[start - 1]).astype(np.int16)
    diagonals = longest + width - 1
    rest = np.zeros((diagonals, n, width), np.uint8)
    kind = np.zeros((diagonals, n, width), np.uint8)
    d, g, w = rest.strides
    skewed = lambda x: np.lib.stride_tricks.as_strided(x, (longest, n, width), (d, g, d + w))
    skewed(rest)[:] = out[row.T]
    skewed(kind)[:] = np.where(inside, kinds[row], NONE).T[:, :, None]
    one, two = np.zeros((n, width + 1), np.int16), np.zeros((n, width + 1), np.int16)  # the last diagonals, with a zero to the left
    column = np.arange(width)
    for k in range(diagonals):
        first = min(k, width)  # on diagonal k, column k is in row 0: what it looks up to is the row above the run
        up, left, corner = one[:, 1:].copy(), one[:, :-1], two[:, :-1].copy()
        if k < width:
            up[:, first] = above[:, first]
            corner[:, first] = above[:, first - 1] if first else 0
        f = kind[k]
        guess = np.where(f == UP, up, 0)
        average, paeth = f == AVERAGE, f == PAETH
        if average.any():
            guess = np.where(average, (left + up) >> 1, guess)
        if paeth.any():
            guess = np.where(paeth, _paeth(left, up, corner), guess)
        rest[k] = (rest[k] + guess) & 255
        two, one = one, two
        one[:, 1:] = np.where(column <= k, rest[k], 0)
    known = np.ascontiguousarray(skewed(rest).transpose(1, 0, 2))
    out[row[inside]] = known[inside]


def _filtered_rows(data: bytes) -> np.ndarray:
    """The filter byte and residues of each row of a grey 8-bit PNG; ValueError or zlib.error where a checksum or the layout is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, idat, size, ended = 8, [], None, False
    while at < len(data) and not ended:
        length = int.from_bytes(data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(data) < at + 12 + length or struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            idat.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not a whole grey 8-bit picture without interlace")
    width, height = size[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
    if len(raw) != height * (width + 1):
        raise ValueError("picture data of another size")
    return raw.reshape(height, width + 1)


def decode_png(data: bytes) -> np.ndarray:
    """The (height, width) samples of a grey 8-bit PNG; ValueError or zlib.error where a checksum or the layout is wrong."""
    raw = _filtered_rows(data)
    return unfilter(raw[:, 0], raw[:, 1:])


def decode_pngs(pictures: list[bytes]) -> list[np.ndarray]:
    """Samples of several pictures of one width, undone together."""
    raw = [_filtered_rows(x) for x in pictures]
    if len({x.shape[1] for x in raw}) > 1:
        return [unfilter(x[:, 0], x[:, 1:]) for x in raw]
    cut = np.append(0, np.cumsum([len(x) for x in raw]))
    rows = np.concatenate(raw)
    return np.split(unfilter(rows[:, 0], rows[:, 1:], cut[:-1][np.diff(cut) > 0]), cut[1:-1])


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


def _shrunk(samples: np.ndarray) -> np.ndarray:
    """Means over SIDE x SIDE areas; a picture with fewer rows repeats them."""
    height, width = samples.shape
    by_row = samples.reshape(height, SIDE, width // SIDE).mean(axis=2)
    edge = np.arange(SIDE) * height // SIDE
    if height < SIDE:
        return by_row[edge]
    return np.add.reduceat(by_row, edge, axis=0) / np.diff(np.append(edge, height))[:, None]


def picture_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the low cosine-transform coefficients lie above their median; the first (the mean) counts as zero."""
    c = _cosines()
    low = (c @ _shrunk(samples) @ c.T).ravel().round(6)
    low[0] = 0
    return np.packbits(low > np.median(low)).tobytes()


def payload(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of the width."""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


_MEDIA = "doc_id long, n_bytes long, media binary"
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"


def _slices(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows some at a time, of about `size` bytes in the column; a larger value is alone."""
    for b in batches:
        length = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(length.tolist()):
            if i > at and (held + n > size or i - at == 1024):
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)


def _to_media(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, "text"):
        texts = [(x or "").encode() for x in b.column("text").to_pylist()]
        media = [encode_png(np.frombuffer(payload(x), np.uint8).reshape(-1, WIDTH), level) for x in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, "media", 1 << 20):
        out: list[list] = [[] for _ in range(7)]
        media = b.column("media").to_pylist()
        for data, samples in zip(media, decode_pngs(media), strict=True):
            stored, code = samples.tobytes(), picture_hash(samples)
            row = (len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), code.hex(), code)
            for column, x in zip(out, row, strict=True):
                column.append(x)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in _FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=names)


def text_pictures(docs: DataFrame, level: int = 6) -> DataFrame:
    """(doc_id, n_bytes, media) of docs(doc_id long, text string, ...): each text's UTF-8 bytes as a PNG in a binary column.

    Null or empty text: one row of zero samples. Repeated rows and equal texts have equal pictures. A null doc_id stays
    null. Other columns are not read. Texts of any length: a picture has as many rows as it needs. An empty table gives no row.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_to_media, level=level), _MEDIA)


def picture_features(media: DataFrame) -> DataFrame:
    """Decodes media(doc_id, n_bytes, media) and returns sizes, digests and the hash, as hex (`feature`) and bytes (`phash`).

    A picture whose checksums fail stops the job. Equal pictures have equal rows, each row its own; a null doc_id stays
    null. Other columns are not read. An empty table gives no row.
    """
    ship(media.sparkSession)
    return media.mapInArrow(_features, _FEATURES)


def media_features(docs: DataFrame) -> DataFrame:
    """picture_features of docs' pictures, which are written to Parquet in the shared folder and read back first."""
    return picture_features(materialize(text_pictures(docs), "pictures"))
