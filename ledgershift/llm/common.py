"""Session, scratch tables and byte packing shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import mark, materialize, release, scratch_dir, scratch_path, ship  # noqa: F401

#: ASCII white space of the contracts, `[\x20\x09-\x0D]`, as text for translate().
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: A run of anything else is a word (Java and RE2 syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside operators that order documents: it comes after every id.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark opens the path."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(left: DataFrame, right: DataFrame, key: str, share: int = 10_000) -> DataFrame:
    """left joined with right, a table with one row a key, where a few keys may hold most of left's rows.

    Keys with more than 1 / `share` of left's rows, so fewer than `share` of them, are broadcast; the others are
    shuffled. left is read three times: a written table.
    """
    total = left.count()
    hot = materialize(left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * share > total).select(key), "hot-keys")
    few = F.broadcast(materialize(right.join(F.broadcast(hot), key), "hot-rows"))
    return left.join(few, key).unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key))


def n_splits(df: DataFrame) -> int:
    """Partitions of df's plan (file splits for a table scan); nothing runs."""
    return max(1, df.rdd.getNumPartitions())


def bucket_count(df: DataFrame, least: int = 1024, most: int = 65536) -> int:
    """Hash buckets for an exchange of packed hashes: a power of two that follows the input's splits."""
    n = least
    while n < min(most, 4 * n_splits(df)):
        n *= 2
    return n


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in text; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of text in order; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.array().cast("array<string>"))


_TYPES = ("<u1", "<u2", "<u4", "<u8", "<i4", "<i8")


def pack(*arrays: np.ndarray) -> bytes:
    """Several arrays as one byte string."""
    head, body = [len(arrays)], []
    for a in arrays:
        kind = a.dtype.newbyteorder("<").str.replace("|", "<")
        head += [_TYPES.index(kind), len(a)]
        body.append(np.ascontiguousarray(a).tobytes())
    return np.array(head, "<i8").tobytes() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of pack()."""
    n = int(np.frombuffer(data, "<i8", 1)[0])
    head = np.frombuffer(data, "<i8", 1 + 2 * n)[1:].reshape(n, 2)
    at, out = 8 * (1 + 2 * n), []
    for kind, length in head.tolist():
        out.append(np.frombuffer(data, _TYPES[kind], length, at))
        at += out[-1].nbytes
    return out
