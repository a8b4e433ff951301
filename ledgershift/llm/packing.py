"""Cost-balanced packing of documents into training sequences.

A sequence costs `linear` a token and `quadratic` a squared piece length (attention stays inside a document). Within a
group of documents the pieces go in descending length to the cheapest sequence that has room for them; what fits
nowhere whole is cut, and fills the cheapest sequences with capacity left. A group has as few sequences as its tokens
need, so its padding is less than one sequence.

Scale: one pass, no shuffle. A task packs its own split in groups of about `group_tokens`; memory is one group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .kernels import blocks
from .token_ids import encode_column

CAPACITY = 4096
GROUP_TOKENS = 4 << 20
#: Words that a worker keeps.
CACHED = 600_000
#: Cost of a token, and of a pair of tokens of one piece, in the units of a model of width 4096.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Pieces (item, start, length, sequence) and each sequence's cost.

    Items longer than the capacity first give full sequences. The rest go in descending length (ties: by position) to
    the cheapest sequence with room; those without room are kept aside by capacity left until a shorter item fits.
    """
    pieces: list[tuple[int, int, int, int]] = []
    costs: list[float] = []
    full = linear * capacity + quadratic * capacity * capacity
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths.tolist()):
        for k in range(n // capacity):
            pieces.append((i, k * capacity, capacity, len(costs)))
            costs.append(full)
        if n % capacity:
            rest.append((n % capacity, i, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    first, m = len(costs), -(-sum(x[0] for x in rest) // capacity)
    left = [capacity] * m
    cost = [0.0] * m
    heap = [(0.0, s) for s in range(m)]
    aside: list[tuple[int, int]] = []

    def put(n: int, i: int, at: int, s: int) -> None:
        pieces.append((i, at, n, first + s))
        left[s] -= n
        cost[s] += linear * n + quadratic * n * n
        if left[s]:
            heapq.heappush(heap, (cost[s], s))

    for n, i, at in rest:
        while aside and -aside[0][0] >= n:
            s = heapq.heappop(aside)[1]
            heapq.heappush(heap, (cost[s], s))
        while heap and left[heap[0][1]] < n:
            s = heapq.heappop(heap)[1]
            heapq.heappush(aside, (-left[s], s))
        if heap:
            put(n, i, at, heapq.heappop(heap)[1])
            continue
        heap += [(cost[s], s) for _, s in aside]
        aside.clear()
        heapq.heapify(heap)
        while n:
            s = heapq.heappop(heap)[1]
            some = min(n, left[s])
            put(some, i, at, s)
            n, at = n - some, at + some
    return pieces, costs + cost


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int, group_tokens: int, cached: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in PIECES.split(", ")]
    made = held = 0
    ids: list[np.ndarray] = []
    docs: list[int | None] = []

    def packed() -> pa.RecordBatch:
        nonlocal made
        pieces, costs = assign(np.array([len(x) for x in ids]), capacity)
        pieces.sort(key=lambda x: x[3])
        item, start, length, sequence = np.array(pieces, np.int64).reshape(-1, 4).T
        used = np.bincount(sequence, weights=length, minlength=len(costs)).astype(np.int64)
        before = np.cumsum(length) - length
        first = np.ones(len(sequence), bool)
        first[1:] = sequence[1:] != sequence[:-1]
        offset = before - before[first][np.cumsum(first) - 1]
        crc = [zlib.crc32(ids[i][a : a + n]) for i, a, n in zip(item.tolist(), start.tolist(), length.tolist(), strict=True)]
        out = [pa.array([docs[i] for i in item.tolist()], pa.int64()), start, length, np.array(crc, np.int64), np.array([len(ids[i]) for i in item.tolist()], np.int64)]
        out += [(part << 40) + made + sequence, offset, used[sequence], np.array(costs)[sequence]]
        made += len(costs)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=names)

    for block in blocks(batches, size=1 << 20):
        ids += encode_column(block.column("text"), path, end_id, cached)
        docs += block.column("doc_id").to_pylist()
        held += sum(map(len, ids[len(ids) - block.num_rows :]))
        if held >= group_tokens:
            yield packed()
            held, ids, docs = 0, [], []
    if ids:
        yield packed()


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, cached: int = CACHED) -> DataFrame:
    """Pieces of every row of docs(doc_id long, text string, ...) in sequences of at most `capacity` tokens.

    path: a tokenizer file; end_id follows each document's ids, so a null or empty text is a document of one token.
    Repeated rows are packed each; equal lengths go in the order of the split; a text of any length is cut into full
    sequences and a rest. A null doc_id stays null. Other columns are not read. An empty table gives no piece.
    sequence_id: the split's number, then a number in it. cached: words that a worker keeps; it changes time and memory only.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_pack, path=path, end_id=end_id, capacity=capacity, group_tokens=group_tokens, cached=cached), PIECES)
