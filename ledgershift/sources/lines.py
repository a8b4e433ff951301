"""Line documents: a text or a list of lines becomes ordered, addressable, hashed fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clause, clean

#: Limits of one document: it fails as a whole, nothing is cut.
MOST_FRAGMENTS, MOST_CHARS = 20_000, 5_000_000


def fragments(docs: DataFrame, name: str, text: str, period: str = "before") -> DataFrame:
    """document, line_no, locator, text, frag_id for each non-blank line of docs(name, text).

    frag_id: period, ten digits of the name's hash, twenty of the whole text's, the line's number. locator: the running
    clause number where the line has none of its own.
    """
    stamp = F.concat_ws(":", F.lit(period), F.substring(F.sha2(F.col(name).cast("string"), 256), 1, 10), F.substring(F.sha2(F.col(text), 256), 1, 20))
    rows = docs.select(F.col(name).alias("document"), stamp.alias("stamp"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw"))
    rows = rows.withColumn("text", clean("raw")).where("text <> ''").withColumn("line_no", F.col("line_no") + 1)
    own = F.nullif(clause(F.col("text")), F.lit(""))
    order = Window.partitionBy("document").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    running = F.coalesce(F.last(own, ignorenulls=True).over(order), F.lit(""))
    return rows.select("document", "line_no", running.alias("locator"), "text", F.concat_ws(":", "stamp", F.col("line_no").cast("string")).alias("frag_id"))


def limit_errors(docs: DataFrame, name: str, text: str, most_lines: int = MOST_FRAGMENTS, most_chars: int = MOST_CHARS) -> DataFrame:
    """document, n_lines, n_chars of documents over a limit."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: clean(x) != ""))
    rows = docs.select(F.col(name).alias("document"), lines.cast("long").alias("n_lines"), F.length(text).cast("long").alias("n_chars"))
    return rows.where((F.col("n_lines") > most_lines) | (F.col("n_chars") > most_chars))


def clause_spans(text):
    """array<struct<at, text>> of a paragraph cut at inline clause markers ("5.3. ") after a sentence's end; at counts from 1."""
    mark = "\x01"
    cut = F.split(F.regexp_replace(text, r"(?<=[.;:!?]\s|\n)(?=\d+(?:\.\d+)+\.?\s)", mark), mark)
    size = F.transform(cut, lambda x: F.length(x))
    at = F.transform(cut, lambda x, i: F.aggregate(F.slice(size, 1, i), F.lit(1), lambda a, b: a + b))
    return F.arrays_zip(at.alias("at"), cut.alias("text"))
