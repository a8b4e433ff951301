"""Exploration and reporting views: search, pages, top findings, matrix cells, label resolution, chunks, headers, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key, markdown_safe
from .numbering import numbered
from ..session import materialize


def search(rows: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows that hold the query in one of the columns, whatever the case."""
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def page(rows: DataFrame, priority: str, order: list[str], key: str, number: int, size: int) -> DataFrame:
    """One page of rows by the place of `priority` in `order`, then key."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col(priority))
    return rows.orderBy(place, key).offset(number * size).limit(size)


def top_findings(rows: DataFrame, key: str, score: str, least: float = 0.4, most: int = 10) -> DataFrame:
    """The best findings from `least` on, ties by key."""
    return rows.where(F.col(score) >= least).orderBy(F.desc(score), key).limit(most)


def matrix_cells(owned: DataFrame) -> DataFrame:
    """fn, owner, cell (kept, left, joined, none) for each function and owner of owned(fn, owner, late).

    The matrix has a cell for each function and owner by definition; both lists are distinct sets of a report's size.
    """
    cell = owned.groupBy("fn", "owner").agg(F.bool_or(~F.col("late")).alias("b"), F.bool_or("late").alias("a"))
    owners = owned.agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    grid = owned.select("fn").distinct().crossJoin(owners).select("fn", F.explode("owners").alias("owner"))  # one row of owners
    state = F.when(F.col("b") & F.col("a"), "kept").when(F.col("b"), "left").when(F.col("a"), "joined").otherwise("none")
    return grid.join(cell, ["fn", "owner"], "left").select("fn", "owner", state.alias("cell"))


def first_seen(producers: list[DataFrame], key: str) -> DataFrame:
    """key, place: each key of the producers(ord, key) once, numbered where it is first seen, one producer after another."""
    rows = None
    for i, some in enumerate(producers):
        part = some.select(F.col(key), F.lit(i).alias("producer"), "ord").where(F.col(key).isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(key).agg(F.min(F.struct("producer", "ord")).alias("at"))
    return numbered(first, "at.producer", "at.ord", key, name="place").select(key, F.col("place").cast("long").alias("place"))


def collected_sources(producers: list[DataFrame], key: str, text: str) -> DataFrame:
    """key, place, text of the producers(ord, key, text): a source keeps the place where it was first given and what was given last."""
    rows = None
    for i, some in enumerate(producers):
        part = some.select(F.col(key), F.lit(i).alias("producer"), "ord", F.col(text)).where(F.col(key).isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    last = rows.groupBy(key).agg(F.max(F.struct("producer", "ord", text)).alias("last"))
    return first_seen(producers, key).join(last.select(key, F.col("last")[text].alias(text)), key)


def resolve_labels(rows: DataFrame, key: str, label: str, aliases: DataFrame) -> DataFrame:
    """key, codes, state: a label's codes by its normal form; resolved with one, ambiguous with more, unknown with none."""
    known = aliases.select(label_key(F.col("label")).alias("_k"), "code").distinct()
    out = rows.select(key, label_key(F.col(label)).alias("_k")).join(known, "_k", "left").groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return out.withColumn("state", F.when(F.size("codes") == 1, "resolved").when(F.size("codes") > 1, "ambiguous").otherwise("unknown"))


def chunks(rows: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """key, part, parts, chunk: a long cell in parts of `size` characters; an empty one is one part."""
    parts = F.ceil(F.greatest(F.length(text), F.lit(1)) / size).cast("int")
    out = rows.select(key, F.col(text).alias("_t"), parts.alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    return out.select(key, "part", "parts", F.substr("_t", (F.col("part") - 1) * size + 1, F.lit(size)).alias("chunk"))


def header_rows(cells: DataFrame, grid: list[str], is_header: Column, within: int = 30) -> DataFrame:
    """The first of a grid's first rows where a cell looks like a header: grid keys, header_row."""
    return cells.where((F.col("r") <= within) & is_header).groupBy(*grid).agg(F.min("r").cast("int").alias("header_row"))


def _run(n: int):
    return lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "), F.lit(n))


def _cut(size: int):
    return lambda i: F.xxhash64(F.substr("text", i, F.lit(size)), F.lit(-size))


def contained_quotes(docs: DataFrame, key: str, quotes: DataFrame, quote_key: str, words: int = 4) -> DataFrame:
    """(key, quote_key) where a text holds a quote literally.

    Candidates share a hash: of the quote's first `words` words inside (neither its first nor its last, which a text may
    have as parts of longer words), or of a whole quote of one or two words with as many characters anywhere in the text.
    Only keys and hashes are exploded and shuffled; the literal test then fetches each candidate's text. Empty quotes are
    in no text. Repeated rows give one pair.
    """
    q = quotes.select(F.col(quote_key), F.col("text").alias("quote")).where("quote <> ''").withColumn("w", F.split("quote", r"\s+"))
    q = q.withColumn("n", F.least(F.size("w") - 2, F.lit(words)))
    q = q.withColumn("size", F.when(F.col("n") < 1, F.length("quote")))
    head = F.xxhash64(F.array_join(F.slice("w", 2, F.greatest(F.col("n"), F.lit(1))), " "), "n")
    q = materialize(q.select(quote_key, "quote", "n", "size", F.when(F.col("n") >= 1, head).otherwise(F.xxhash64("quote", -F.col("size"))).alias("h")), "quotes")
    kinds = q.select("n", "size").distinct().collect()  # the numbers of words up to `words`, and lengths of short quotes
    text = docs.select(F.col(key), F.col("text")).withColumn("w", F.split("text", r"\s+"))
    found = [F.array().cast("array<bigint>")]
    for n in sorted({r.n for r in kinds if r.n >= 1}):
        runs = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), _run(n))
        found.append(F.when(F.size("w") >= n, runs).otherwise(found[0]))
    for size in sorted({r.size for r in kinds if r.size}):
        cuts = F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), _cut(size))
        found.append(F.when(F.length("text") >= size, cuts).otherwise(found[0]))
    item = text.select(key, F.explode(F.array_distinct(F.concat(*found))).alias("h"))
    pair = materialize(item.join(q.select("h", quote_key), "h").select(key, quote_key).distinct(), "quote-candidates")
    full = pair.join(docs.select(key, "text"), key).join(q.select(quote_key, "quote"), quote_key)
    return full.where(F.contains("text", "quote")).select(key, quote_key).distinct()


def executive_overview(findings: DataFrame) -> DataFrame:
    """name, value rows of the counters that open a report; findings(kind, score)."""
    one = findings.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("loss", "duplicate", "conflict")), F.count_if(F.col("score") >= 0.7).alias("strong"))
    return one.unpivot([], ["loss", "duplicate", "conflict", "strong"], "name", "value")


def markdown_rows(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Numbered Markdown table lines, ordered by line_no."""
    cells = F.concat_ws(" | ", *(markdown_safe(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    return numbered(rows, order, *columns, name="line_no").select("line_no", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
