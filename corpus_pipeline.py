"""Corpus pipeline: quality, near duplicates, repeated passages, source mix, packing; each stage works on what the one before wrote.

run(spark, sf_dir) applies STAGES to `documents`. A stage takes (spark, docs, sf_dir); docs has the columns of documents,
and so has the result of every stage but the last, whose rows are the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgershift.llm.common import mark, materialize, release, table
from ledgershift.llm.importance import NEW_COLUMNS, resample
from ledgershift.llm.mixing import mixed_documents
from ledgershift.llm.ngram_join import near_duplicates
from ledgershift.llm.packing import pack_documents
from ledgershift.llm.queries import TOKENIZER
from ledgershift.llm.substring_dedup import remove_repeats

#: Words that a worker of the last stage keeps: fewer than alone, as its workers hold what other stages left.
CACHED = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. Empty and null texts have log ratio 0 and are drawn like any other; repeated rows alike.

    Ties at the limit stay; without labels of both kinds, all stay. Columns of the operator's names are those of docs. An empty
    table stays empty; a very long text is scored whole.
    """
    aside = {c: f"__{c}" for c in docs.columns if c.lower() in NEW_COLUMNS}
    kept = resample(docs.withColumnsRenamed(aside), table(spark, sf_dir, "labels")).where("kept")
    return kept.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest doc_id; documents without a word stay.

    Repeated rows of a doc_id go but for one. Rows without a doc_id stay. An empty table stays empty; very long texts are compared whole.
    """
    groups = near_duplicates(docs, counts=False).where(~(F.col("doc_id").eqNullSafe(F.col("component_id")))).select("doc_id").distinct()
    kept = docs.join(materialize(groups, "near-duplicates"), "doc_id", "left_anti").select(*docs.columns)
    if not _repeats(kept):
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1).isEmpty()


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; one that loses all its words goes. n_chars follows the text.

    Null and empty texts stay, as empty ones. Repeated rows of a doc_id lose nothing to each other; rows without a doc_id
    come after all others. Other columns pass. An empty table stays empty; of a very long text all windows count.
    """
    kept = remove_repeats(docs, keep_texts=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by training position; a row for each time.

    Null and empty texts are not taken; a null source is the last one; each repeated row is taken by itself. An empty table
    stays empty; a very long text is taken whole, some times or none.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; a null or empty text is one token, each repeated row a document.

    An empty table gives no piece; a very long text is cut into as many as it needs."""
    return pack_documents(docs, TOKENIZER, end_id=2, cached=CACHED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("substring", substring),
    ("mix", mix),
    ("pack", pack),
]

#: No SQL expresses the resampling, the shingle join or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result but the last written as Parquet in the shared folder and read again."""
    docs, since = table(spark, sf_dir, "documents"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since, docs)  # what the stage has written besides, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
