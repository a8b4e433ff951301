"""Substring dedup: a log-structured fingerprint index of 50-word windows, for whole corpora and for increments.

Fingerprints. The 25-word grams of a text are hashed; a window's fingerprint is the least hash of its 26 grams, so equal
windows have equal fingerprints and neighbours mostly share theirs (about 1 fingerprint in 13 words). A text has one entry
for each of its fingerprints: (fingerprint f, context c, doc_id), c being the sum over hashes of its windows with that f.

Index. For each hash bucket an immutable run, sorted by (f, c), keeps the smallest doc_id for each (f, c). A batch becomes
a sorted run, is merge-joined with what is there, and compacted with it. An entry that meets an equal (f, c) of a smaller
doc_id is a duplicate with all its windows, and needs no more work: whole copies, and the inside of shared passages, end
here. Where one f has several contexts, the first document of each context is verified: the windows themselves (64 bits,
and 32 of the fingerprint) are sent to their bucket, and those that a smaller doc_id has are duplicates. So no pairs are
made, and a passage of a third of all documents costs a block of texts one entry a context.

The text is shuffled once by doc_id, to meet its answers; both joins that need it use the same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, bucket_count, materialize, pack, scratch_path, ship, unpack
from .kernels import Words, blocks, grams, hash_words, mix, text_buffer

WINDOW = 50
GRAM = 25
#: Increments in which a whole table is ingested, each through the written index of the ones before, and batches of an increment; both by ascending doc_id.
INCREMENTS, BATCHES = 2, 2

_SENT = pa.schema([("key", pa.int64()), ("data", pa.binary())])
_CODES = pa.list_(pa.int64())
_TOLD = pa.schema([("doc_id", pa.int64()), ("codes", _CODES), ("full", pa.bool_()), ("bucket", pa.int64()), ("run", pa.binary())])
_TOLD_DDL = "doc_id long, codes array<long>, full boolean, bucket long, run binary"


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside a text: its first word, its text, its hash and its fingerprint."""
    owner = w.owner
    if len(owner) < WINDOW:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none
    low = grams(w.hash, GRAM)
    span, reach = WINDOW - GRAM + 1, 1
    while 2 * reach <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    at = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
    return at, owner[at], grams(w.hash, WINDOW)[at], low[at]


def _entries(text: np.ndarray, window: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, f, c) once for each fingerprint of a text, and for each window the number of its entry."""
    order = np.lexsort((f, text))
    t, g = text[order], f[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    at = np.flatnonzero(first)
    c = np.add.reduceat(mix(window[order]), at) if len(at) else np.zeros(0, np.uint64)
    of = np.empty(len(t), np.int64)
    of[order] = np.cumsum(first) - 1
    return t[at], g[at], c, of


def _code(f: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(f * np.uint64(0x9E3779B97F4A7C15) + c).view(np.int64)


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys (the last one leads), and which of that order opens a group of all keys but the first."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys[1:]])
    return order, new


def _anchors(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A block's entries by bucket, the smallest doc_id for each (f, c); the other ones are duplicates here and now (a key of the block's own, below 0)."""
    part = TaskContext.get().partitionId()
    for seq, block in enumerate(blocks(batches, size=2 << 20)):
        ids = block.column("doc_id").to_numpy()
        _, text, window, f = _windows(hash_words(*text_buffer(block.column("text"))))
        t, f, c, _ = _entries(text, window, f)
        doc = ids[t]
        order, new = _first_of(doc, c, f)
        doc, f, c = doc[order], f[order], c[order]
        least = np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), len(doc)))) if len(doc) else doc
        late = doc > least
        keys, data = [-1 - (part << 32 | seq)], [pack(doc[late].astype("<i8"), _code(f[late], c[late]).astype("<i8"))]
        doc, f, c = doc[new], f[new], c[new]
        cut = np.searchsorted(f >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        for p in range(1 << bits):
            a, b = cut[p], cut[p + 1]
            if a < b:
                keys.append(p)
                data.append(pack(f[a:b], c[a:b], doc[a:b].astype("<i8")))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], schema=_SENT)


def _place(run: list[np.ndarray], f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ascending (f, c): the place of each in the sorted run, and whether it is there. One fingerprint's contexts are halved until found."""
    low, high = np.searchsorted(run[0], f, "left"), np.searchsorted(run[0], f, "right")
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (run[1][np.minimum(middle, len(run[1]) - 1)] < c)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    there = low < len(run[0])
    there[there] = (run[0][low[there]] == f[there]) & (run[1][low[there]] == c[there])
    return low, there


def _merge(run: list[np.ndarray], new: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Merge-join a sorted batch with a sorted run: the compacted run; (doc, code) of whole duplicates; (doc, code) to verify.

    Linear in both: the run is not sorted again, new entries are put in their places. To verify are all entries of a
    fingerprint with several contexts, one of which is new or has an earlier document now.
    """
    f, c, doc = new
    first = np.ones(len(f), bool)
    first[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(first) - 1
    uf, uc, least = f[first], c[first], doc[first]
    at, there = _place(run, uf, uc)
    known = run[2].copy()
    before = least.copy()
    before[there] = known[at[there]]
    changed = ~there | (least < before)
    least = np.minimum(least, before)
    known[at[there]] = least[there]
    late = doc > least[group]
    fresh = ~there
    kept = [np.insert(x, at[fresh], y[fresh]) for x, y in zip((run[0], run[1], known), (uf, uc, least), strict=True)]
    of_f = np.ones(len(kept[0]), bool)
    of_f[1:] = kept[0][1:] != kept[0][:-1]
    start = np.flatnonzero(of_f)
    contexts = np.diff(np.append(start, len(of_f)))
    touched = np.zeros(len(start), bool)
    touched[np.searchsorted(kept[0][start], uf[changed])] = True
    open_ = np.repeat(touched & (contexts > 1), contexts)
    return kept, [doc[late], _code(f[late], c[late])], [kept[2][open_], _code(kept[0][open_], kept[1][open_])]


def _bucket(rows: pa.Table, bounds: tuple[int, ...]) -> pa.Table:
    """Ingest a bucket's entries batch by batch (ascending doc_id) into its run; also passes on what blocks have found."""
    key = rows.column("key")[0].as_py()
    parts = [unpack(x) for x in rows.column("data").to_pylist()]
    if key < 0:
        doc, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _told(doc, code, np.ones(len(doc), bool))
    run = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    history = [x for x in parts if len(x) == 4]
    for x in history:  # runs of earlier calls: compacted, no answers of their own
        run = _merge(run, x[:3])[0]
    new = [np.concatenate(x) for x in zip(*(x for x in parts if len(x) == 3), strict=True)] or run[:0]
    docs, codes, full = [], [], []
    if new:
        batch = np.searchsorted(np.array(bounds, np.int64), new[2], "left")
        for b in np.unique(batch):
            some = [x[batch == b] for x in new]
            order, _ = _first_of(some[2], some[1], some[0])
            run, late, check = _merge(run, [x[order] for x in some])
            docs += [late[0], check[0]]
            codes += [late[1], check[1]]
            full += [np.ones(len(late[0]), bool), np.zeros(len(check[0]), bool)]
    none = [np.zeros(0, np.int64)]
    return _told(np.concatenate(docs or none), np.concatenate(codes or none), np.concatenate(full or [np.zeros(0, bool)]), key, pack(*run, np.zeros(0, "<u1")))


def _dealt_again(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Runs of another bucket number, cut at this one's bucket limits; parts of one bucket are merged there."""
    for b in batches:
        for data in b.column("run"):
            f, c, doc, end = unpack(data.as_py())
            cut = np.flatnonzero(np.diff(f >> np.uint64(64 - bits), prepend=np.uint64(0))) if len(f) else np.zeros(0, np.int64)
            cut = np.unique(np.concatenate(([0], cut, [len(f)])))
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            keys = [int(f[x] >> np.uint64(64 - bits)) for x, _ in spans]
            runs = [pack(f[x:y], c[x:y], doc[x:y], end) for x, y in spans]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(runs, pa.binary())], schema=_SENT)


def _by_doc(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Each document once, with the list of its codes."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    cut = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1 if len(doc) else 0))
    return doc[cut], pa.ListArray.from_arrays(pa.array(np.append(cut, len(doc)).astype(np.int32)), pa.array(code[order], pa.int64()))


def _told(doc: np.ndarray, code: np.ndarray, full: np.ndarray, bucket: int | None = None, run: bytes | None = None) -> pa.Table:
    """A row for each document with codes of whole duplicates, one for each with codes to verify, and the bucket's run."""
    out = []
    for kind in (True, False):
        docs, codes = _by_doc(doc[full == kind], code[full == kind])
        n = len(docs)
        out.append(pa.table([pa.array(docs, pa.int64()), codes, pa.array([kind] * n, pa.bool_()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=_TOLD))
    if run is not None:
        out.append(pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, _CODES), pa.nulls(1, pa.bool_()), pa.array([bucket], pa.int64()), pa.array([run], pa.binary())], schema=_TOLD))
    return pa.concat_tables(out)


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each; a null is an empty list."""
    n = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), n)


def _pairs_in(row: np.ndarray, code: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which (row, code) are among (rows, codes)."""
    if not len(codes) or not len(code):
        return np.zeros(len(code), bool)
    have = np.sort(mix(codes.view(np.uint64) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    want = mix(code.view(np.uint64) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want


def _window_code(window: np.ndarray, f: np.ndarray) -> np.ndarray:
    """One value for a window and its fingerprint."""
    return mix(window + mix(f + np.uint64(5))).view(np.int64)


def _to_verify(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Windows of entries to verify, by bucket, each once a block with the smallest doc_id; later ones are duplicates here and now."""
    part = TaskContext.get().partitionId()
    for seq, block in enumerate(blocks(batches, size=2 << 20)):
        ids = block.column("doc_id").to_numpy()
        _, text, window, f = _windows(hash_words(*text_buffer(block.column("text"))))
        t, g, c, of = _entries(text, window, f)
        codes, rows = _ragged(block.column("check"))
        mine = _pairs_in(t, _code(g, c), rows, codes)[of]
        w, v, doc = window[mine], f[mine], ids[text[mine]]
        order, new = _first_of(doc, v, w)
        w, v, doc = w[order], v[order], doc[order]
        least = np.repeat(doc[new], np.diff(np.append(np.flatnonzero(new), len(doc)))) if len(doc) else doc
        late = doc > least
        keys, data = [-1 - (part << 32 | seq)], [pack(doc[late].astype("<i8"), _window_code(w[late], v[late]).astype("<i8"))]
        w, v, doc = w[new], v[new], doc[new]
        cut = np.searchsorted(w >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        for p in range(1 << bits):
            a, b = cut[p], cut[p + 1]
            if a < b:
                keys.append(p)
                data.append(pack(w[a:b], mix(v[a:b]).astype("<u4"), doc[a:b].astype("<i8"), _window_code(w[a:b], v[a:b]).astype("<i8")))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], schema=_SENT)


def _verified(rows: pa.Table) -> pa.Table:
    """(doc_id, window codes) of a bucket's windows that a smaller doc_id has too."""
    parts = [unpack(x) for x in rows.column("data").to_pylist()]
    if rows.column("key")[0].as_py() < 0:
        doc, code = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        w, v, doc, code = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new = _first_of(doc, v, w)
        doc, code = doc[order], code[order]
        late = doc > doc[new][np.cumsum(new) - 1]
        doc, code = doc[late], code[late]
    docs, codes = _by_doc(doc, code)
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "codes": codes})


def _cut(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], texts: bool) -> Iterator[pa.RecordBatch]:
    """Words removed and kept; only texts with answers are hashed again. With texts, columns `names` of documents that keep a word or had none."""
    for block in blocks(batches, size=2 << 20):
        full, full_row = _ragged(block.column("__full"))
        dup, dup_row = _ragged(block.column("__windows"))
        some = np.unique(np.concatenate((full_row, dup_row)))
        data, offsets = text_buffer(block.column("text"))
        raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        split: list[list[bytes]] = [x.split() for x in raw]
        n = np.array([len(x) for x in split], np.int64)
        removed = np.zeros(len(raw), np.int64)
        if len(some):
            lengths = [len(raw[i]) for i in some.tolist()]
            w = hash_words(np.frombuffer(b"".join(raw[i] for i in some.tolist()), np.uint8), np.append(0, np.cumsum(lengths)))
            at, text, window, f = _windows(w)
            t, g, c, of = _entries(text, window, f)
            gone = _pairs_in(some[t], _code(g, c), full_row, full)[of] | _pairs_in(some[text], _window_code(window, f), dup_row, dup)
            edge = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(edge, at[gone], 1)
            np.add.at(edge, at[gone] + WINDOW, -1)
            keep = np.cumsum(edge[:-1]) == 0
            for k, i in enumerate(some.tolist()):
                mine = keep[w.first[k] : w.first[k + 1]]
                removed[i] = len(mine) - int(mine.sum())
                if removed[i]:
                    split[i] = list(compress(split[i], mine.tolist()))
        kept = [b" ".join(x) for x in split]
        if texts:
            own = {c: block.column(c) for c in names}
            own["text"] = pa.array([(k if r else x).decode() for k, r, x in zip(kept, removed.tolist(), raw, strict=True)], pa.string())
            out = pa.RecordBatch.from_arrays(list(own.values()), names=list(own))
            yield out.filter(pa.array((removed == 0) | (removed < n)))
        else:
            digests = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(n), pa.array(removed), digests], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def ingest(docs: DataFrame, index: DataFrame | None = None, history: DataFrame | None = None, batches: int = BATCHES, buckets: int | None = None, keep_texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Deduplicate docs(doc_id long, text string, ...) against itself and what is indexed; returns (result, new index).

    index: the second value of an earlier call, with the bits of its bucket numbers; buckets are not fewer than its own,
    unless given, and runs of another bucket number are dealt again by their fingerprints; history: the (doc_id, text) that it covers.
    An index alone cannot tell which windows of an ambiguous fingerprint its documents had, so it is refused without them.
    result: docs' doc_id, n_words, n_removed, kept_sha256; with keep_texts docs' columns instead, text holding the kept
    words, without documents that lose every word.
    A word goes if a window over it starts in a document of a smaller doc_id, in docs or history, on input texts.
    Null, empty and short texts (under 50 words) lose nothing. Repeated rows with one doc_id are one document, and lose
    nothing to each other. Null doc_ids come after all and do not precede each other. Columns of any other name pass
    with keep_texts, and are not read without. Empty tables give empty results. Very long texts are blocks of their own.
    """
    if index is not None and history is None:
        raise ValueError("an index needs the history that it covers: windows of fingerprints with several contexts are compared among texts")
    ship(docs.sparkSession)
    had = [r.bits for r in index.select("bits").distinct().collect()] if index is not None else []
    bits = buckets.bit_length() - 1 if buckets else max([bucket_count(docs).bit_length() - 1, *had])
    no_null = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")

    def plain(df: DataFrame) -> DataFrame:
        return df.select(no_null, text)

    bounds = _quantiles(docs, batches)
    sent = plain(docs).mapInArrow(partial(_anchors, bits=bits), "key long, data binary")
    if index is not None:
        runs = index.where(F.col("bits") == bits).select(F.col("bucket").alias("key"), F.col("run").alias("data"))
        if set(had) - {bits}:
            runs = runs.unionByName(index.where(F.col("bits") != bits).select("run").mapInArrow(partial(_dealt_again, bits=bits), "key long, data binary"))
        sent = sent.unionByName(runs)
    told = materialize(sent.groupBy("key").applyInArrow(lambda x: _bucket(x, bounds), _TOLD_DDL), "fingerprints")
    grown = told.where("run is not null").select("bucket", "run", F.lit(bits).alias("bits"))
    every = lambda which: F.array_distinct(F.flatten(F.collect_list(F.when(which, F.col("codes")))))
    answers = told.where("codes is not null").groupBy("doc_id").agg(every(F.col("full")).alias("full"), every(~F.col("full")).alias("check"))
    answers = answers.withColumn("check", F.array_except("check", "full"))
    answers = materialize(answers, "fingerprint-answers")
    corpus = plain(docs) if history is None else plain(docs).unionByName(plain(history))
    check = answers.where(F.size("check") > 0).select(F.col("doc_id").alias("__doc"), "check")
    asked = corpus.join(check, F.col("doc_id") == F.col("__doc")).select("doc_id", "text", "check")
    found = asked.mapInArrow(partial(_to_verify, bits=bits), "key long, data binary").groupBy("key").applyInArrow(lambda x: _verified(x), "doc_id long, codes array<long>")
    found = found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("windows"))
    both = answers.select("doc_id", "full").join(found, "doc_id", "full").select(F.col("doc_id").alias("__doc"), F.col("full").alias("__full"), F.col("windows").alias("__windows"))
    columns = tuple(docs.columns) if keep_texts else ("doc_id", "text")
    rows = docs.withColumns({"doc_id": no_null, "text": text}).select(*(f"`{c}`" for c in columns))
    rows = rows.join(both, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    kinds = {"doc_id": T.LongType(), "text": T.StringType()}
    if keep_texts:
        schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in docs.schema.fields])
    else:
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    out = rows.mapInArrow(partial(_cut, names=columns, texts=keep_texts), schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID))), grown


def _quantiles(docs: DataFrame, parts: int) -> tuple[int, ...]:
    """Ascending doc_ids that cut docs in about equal parts; fewer where they coincide."""
    at = [k / parts for k in range(1, parts)]
    return tuple(sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), at).alias("q")).first()["q"] or ()))) if at else ()


def write_index(index: DataFrame, path: str | None = None) -> DataFrame:
    """The index as files sorted by bucket, in the shared folder unless a path is given, for the next increment."""
    path = path or scratch_path(index.sparkSession, "index")
    index.sortWithinPartitions("bucket").write.option("compression", "zstd").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def remove_repeats(docs: DataFrame, increments: int = INCREMENTS, batches: int = BATCHES, keep_texts: bool = False) -> DataFrame:
    """Each row of docs deduplicated against all docs, as ingest() returns it; see there.

    docs come in increments by ascending doc_id. Each is merge-joined with the index of those before it, which is
    written and read back in between.
    """
    cuts = _quantiles(docs, increments)
    doc_id = F.col("doc_id").cast("long")
    index, out = None, None
    for k in range(len(cuts) + 1):
        later = F.lit(True) if k == 0 else doc_id.isNull() | (doc_id > cuts[k - 1])
        some = docs.where(later & (doc_id <= cuts[k])) if k < len(cuts) else docs.where(later)
        result, grown = ingest(some, index, docs.where(doc_id <= cuts[k - 1]) if k else None, batches, keep_texts=keep_texts)
        out = result if out is None else out.unionByName(result)
        index = write_index(grown) if k < len(cuts) else None
    return out
