"""Token ids in Parquet list columns: delta-encoded ids, bounded row groups and pages, page indexes.

Rows stand in ascending doc_id, dealt by range, so that the files have disjoint id ranges and a reader skips row
groups by doc_id, pages by the column index, and the token column altogether when it asks for metadata only.
Positions (`start`) come from the files' own counts: a running sum in each part, plus the parts before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_splits, scratch_path, ship
from .token_ids import encode_column

#: Bytes of a row group and of a page; rows a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 64 << 10, 2_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            some = batch.slice(k, 512)
            ids = encode_column(some.column("text"), path, end_id)
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.cumsum(n)
            tokens = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(ids).view(np.int32)))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start + ends - n), pa.array(n), tokens], schema=_SCHEMA)
            start += int(ends[-1])


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 1, parts: int | None = None) -> None:
    """Write docs(doc_id, text) as token files in folder `out`, in ascending doc_id (null first; ties by text)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts or 2 * n_splits(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    ids = dealt.mapInArrow(partial(_encode, path=path, end_id=end_id), "doc_id long, part int, part_start long, n_tokens long, tokens array<int>")
    writer = ids.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    writer = writer.option("parquet.enable.dictionary#part", "true").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE)
    writer.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(out)


def _parquet(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, part_start long, n_tokens long, tokens array<int>").parquet(out)


def read_metadata(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens) of each document; the token column is not read. Null and repeated doc_ids are rows like any other."""
    rows = _parquet(spark, out)
    return rows.join(_before(rows), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, out: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, tokens) of documents low <= doc_id < high; row groups and pages outside are skipped.

    Repeated doc_ids are rows each. Without limits all rows are read, those of a null doc_id too; with one, not those.
    """
    rows = _parquet(spark, out)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") < high)
    return rows.select("doc_id", "n_tokens", "tokens")


def _before(rows: DataFrame) -> DataFrame:
    """(part, before): ids in the parts before. One row a part goes through the ordered window, whatever the number of documents."""
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    return sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column("tokens")
        cut, ids = tokens.offsets.to_numpy().tolist(), tokens.values.to_numpy().view("<u4")
        crc = [zlib.crc32(ids[x:y]) for x, y in zip(cut, cut[1:], strict=False)]
        n = np.diff(np.array(cut, np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("part_start"), pa.array(n), pa.array(np.array(crc, np.int64))], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def token_digests(docs: DataFrame, path: str, end_id: int = 1, out: str | None = None) -> DataFrame:
    """Write docs(doc_id long, text string, ...) as token files, read them back, and return doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; a null doc_id comes first and stays null; repeated rows are documents
    each, ties in doc_id go by text. Other columns are not read. An empty table gives no row. A text of any length is one list.
    """
    spark = docs.sparkSession
    out = out or scratch_path(spark, "tokens")
    write_tokens(docs, out, path, end_id)
    rows = _parquet(spark, out)
    read = rows.select("doc_id", "part", "part_start", "tokens").mapInArrow(_digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return read.join(_before(rows), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
