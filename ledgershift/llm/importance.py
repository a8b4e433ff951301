"""Quality classifier by importance resampling: hashed n-gram models of good and of raw text, sampled by Gumbel top-k.

A text is a bag of hashed n-grams: words, pairs of words, word shapes and pairs of shapes (a shape keeps punctuation and
has one letter for a run of capitals, small letters, digits or other letters). Two multinomial models, of texts labelled
good and of the raw corpus, give each n-gram a log ratio; log_ratio is its mean over a text's n-grams, so that long texts
are not certain where short ones are doubtful. Texts are drawn without replacement with probabilities in proportion to
exp(log_ratio / temperature): the k largest of log_ratio + temperature * Gumbel noise, the noise from a hash of doc_id.
k is a budget: the number of texts times the share of good ones among labelled ones, plus `errors` standard errors of it.

Scale: counts of the raw model are over all documents, in vectors of fixed size summed task by task and bucket range by
bucket range, in two levels; only the 64 sums reach the driver. The labelled sample has a bound. Nothing with text is
shuffled. The k-th key is found by histograms over all keys, each of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship
from .kernels import Words, blocks, grams, hash_words, mix, text_buffer

BUCKETS = 1 << 16
#: Labelled rows used at most (the smallest hashes of doc_id).
LABELLED = 20_000
#: Noise in units of the mean log ratio, standard errors added to the budget, and the weight of a bucket's prior in n-grams.
TEMPERATURE, ERRORS, PRIOR = 0.05, 2.0, 10.0
_RANGES, _TASKS = 64, 512
#: What resample() adds to its input's columns.
NEW_COLUMNS = ("log_ratio", "sampling_key", "kept")

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 57, 88, 120, 111
_RUN = np.isin(np.arange(256), [57, 88, 120, 111])


def _shapes(data: np.ndarray, offsets: np.ndarray) -> Words:
    base = int(offsets[0])
    shape = _SHAPE[data[base : int(offsets[-1])]]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~_RUN[shape[1:]]
    keep[(offsets[:-1] - base)[offsets[:-1] < offsets[1:]]] = True
    return hash_words(shape[keep], np.append(0, np.cumsum(keep))[offsets - base])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's index) of every n-gram of the texts (null: none)."""
    data, offsets = text_buffer(column)
    out, own = [], []
    for salt, w in enumerate((hash_words(data, offsets), _shapes(data, offsets))):
        owner = w.owner
        two = grams(w.hash, 2)
        inside = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
        out += [mix(w.hash + np.uint64(2 * salt + 1)), mix(two[inside] + np.uint64(2 * salt + 2))]
        own += [owner, owner[:-1][inside]]
    return (np.concatenate(out) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(own)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts: n-grams of all texts and of good ones, by range of buckets."""
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for block in blocks(batches, size=1 << 20):
        f, own = features(block.column("text"))
        raw += np.bincount(f, minlength=BUCKETS)
        label = block.column("label").fill_null(0).to_numpy(zero_copy_only=False) == 1
        good += np.bincount(f[label[own]], minlength=BUCKETS)
    data = [np.concatenate(x).astype("<i8").tobytes() for x in zip(np.split(raw, _RANGES), np.split(good, _RANGES), strict=True)]
    some = np.full(_RANGES, TaskContext.get().partitionId() // _TASKS, np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(_RANGES, dtype=np.int32)), pa.array(some), pa.array(data, pa.binary())], names=["range", "tasks", "counts"])


def _add(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<i8") for x in rows.column("counts").to_pylist())
    return rows.slice(0, 1).set_column(2, "counts", pa.array([total.astype("<i8").tobytes()], pa.binary()))


def _score(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, size=1 << 20):
        f, own = features(block.column("text"))
        total = np.bincount(own, weights=ratio[f], minlength=block.num_rows).astype(float)  # no n-gram: bincount gives integers
        mean = total / np.maximum(1, np.bincount(own, minlength=block.num_rows))
        yield block.append_column("log_ratio", pa.array(np.round(mean, 9)))


@dataclass
class Model:
    """The log ratio of each bucket, and the share of texts to keep (null: all)."""

    ratio: np.ndarray
    share: float | None


def log_ratios(raw: np.ndarray, good: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log of good's probability over raw's for each bucket; a bucket starts with `prior` n-grams of the common mixture."""
    common = good.sum() / max(1.0, raw.sum())
    return np.log((good + prior * common) / ((raw + prior) * common)) if common else np.zeros(len(raw))


def _noise(doc_id: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id.cast("string"), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def labelled_sample(labels: DataFrame, label: str, most: int = LABELLED, where: Column | None = None) -> DataFrame:
    """(doc_id, label) of at most `most` labelled ids, those with the smallest hashes; an id labelled twice takes the larger label."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows if where is None else rows.where(where)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column log_ratio; no shuffle."""
    ship(docs.sparkSession)
    return docs.mapInArrow(partial(_score, ratio=model.ratio), T.StructType([*docs.schema.fields, T.StructField("log_ratio", T.DoubleType())]))


def counts(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """n-grams in each bucket: of all texts, and of those that sample(doc_id, label) calls good."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left")
    kind = "range int, tasks int, counts binary"
    parts = rows.select("text", "label").mapInArrow(_count, kind)
    sums = parts.groupBy("range", "tasks").applyInArrow(lambda x: _add(x), kind).groupBy("range").applyInArrow(lambda x: _add(x), kind)
    total = np.zeros((_RANGES, 2, BUCKETS // _RANGES), np.int64)
    for r in sums.collect():  # 64 rows of 16 KB, whatever the input
        total[r["range"]] = np.frombuffer(r["counts"], "<i8").reshape(2, -1)
    return total[:, 0].ravel().astype(float), total[:, 1].ravel().astype(float)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, errors: float = ERRORS) -> Model:
    """Models of docs(doc_id, text) and of those with labels(doc_id, quality) = 1. Without labels of both kinds all is kept."""
    ship(docs.sparkSession)
    sample = materialize(labelled_sample(labels, "quality", most), "quality-sample")
    n, n_good = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n_good < n:
        return Model(np.zeros(BUCKETS), None)
    share = n_good / n
    return Model(log_ratios(*counts(docs, sample)), min(1.0, share + errors * (share * (1 - share) / n) ** 0.5))


def _kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The largest value with at least k keys at or above it, to the last bit that bins can tell; keys(key double)."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while low < high:
        width = (high - low) / bins
        if not width or low + width == low:
            break
        slot = F.least(F.lit(bins - 1), F.floor((F.col("key") - F.lit(low)) / F.lit(width))).cast("int")
        inside = keys.where(F.col("key").between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()  # at most `bins` rows
        for r in sorted(inside, key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["a"], r["b"]) == (low, high) or r["a"] == r["b"]:
            return r["a"]
        low, high = r["a"], r["b"]
    return low


def resample(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: int = 17, most: int = LABELLED, columns: tuple[str, ...] | None = None) -> DataFrame:
    """docs(doc_id long, text string, ...) with log_ratio double, sampling_key double and kept boolean.

    columns: those of docs to return, all if not given; without `text` among them texts are scored once, not twice.
    Null or empty text: log ratio 0, so it is drawn like a text that fits both models equally. Repeated rows: equal keys,
    kept or rejected alike; equal keys at the limit are all kept. A null doc_id takes one fixed noise. Empty tables give
    empty results; without labels of both kinds all is kept. Texts of any length: a very long one is a block of its own. Other columns pass through; columns named like the three
    new ones are replaced.
    """
    model = fit(docs, labels, most)
    own = [c for c in columns or docs.columns if c.lower() not in NEW_COLUMNS]
    texts = docs.select(*dict.fromkeys([*own, "doc_id", "text"])).withColumn("text", F.col("text").cast("string"))
    key = F.col("log_ratio") + F.lit(temperature) * _noise(F.coalesce(F.col("doc_id"), F.lit(-1)), seed)

    def keyed(rows: DataFrame) -> DataFrame:
        return score(rows, model).withColumn("sampling_key", key)

    if model.share is None:
        return keyed(texts).select(*own, "log_ratio", "sampling_key", F.lit(True).alias("kept"))
    again = "text" in own
    keys = materialize(keyed(texts.select("doc_id", "text")).select("sampling_key") if again else keyed(texts).drop("text"), "quality-keys")
    n = keys.count()
    limit = _kth_largest(keys.select(F.col("sampling_key").alias("key")), round(n * model.share)) if n else 0.0
    return (keyed(texts) if again else keys).select(*own, "log_ratio", "sampling_key", (F.col("sampling_key") >= F.lit(limit)).alias("kept"))
