"""Quality rules: counts within a document, and the frequency of its lines across the documents of its host.

Only DataFrame functions: the words of a text are an array column, three-word windows are hashed and sorted inside the
row, and lines leave the row as 64-bit hashes. A line is frequent on its host if more than `least_docs` documents and
more than `percent` % of the host's documents have it; a document loses its frequent lines, and is rejected when less
than half of its words or fewer than `least_words` are left.

Scale: the text is read once. Line rows are grouped by (host, line), so a host of a third of all rows is spread over
its lines; a line of a third of all documents is counted before the shuffle. Frequent lines are a written table, so the
join that takes them back to documents can split a frequent line or broadcast a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, words

# Fixed values of the base rules.
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

LEAST_DOCS, LINE_PERCENT = 20, 1
#: What a normalised line leaves out: white space, digits and ASCII punctuation.
NOISE = r"[\x20\x09-\x0D0-9!-/:-@\x5B-\x60{-~]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def repeat_words(w: Column, windows: Column) -> Column:
    """Words of array w in three-word windows found twice or more; windows: sorted structs (h, i) of hash and start."""
    twice = F.filter(
        F.transform(windows, lambda x, k: F.when((x["h"] == F.get(windows, k - 1)["h"]) | (x["h"] == F.get(windows, k + 1)["h"]), x["i"])),
        lambda i: i.isNotNull(),
    )
    covered = F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, host) -> doc_id, host, text_key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines.

    lines: for each distinct normalised line with a letter its hash and the words of all its occurrences.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "host", text.alias("text"), words(text).alias("w"))
    window = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    rows = rows.select("*", F.when(F.size("w") >= 3, F.sort_array(window)).otherwise(empty).alias("g"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    plain = F.transform("l", lambda x: F.struct(F.trim(F.regexp_replace(F.translate(x, _UPPER, _UPPER.lower()), NOISE, " ")).alias("n"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("c")))
    lines = F.transform(F.filter(plain, lambda x: x["n"] != ""), lambda x: F.struct(F.xxhash64(x["n"]).alias("h"), x["c"].cast("long").alias("c")))
    return rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", ASCII_SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w"), F.col("g")).alias("n_repeat_words"),
        lines.alias("lines"),
    )


def quality_rules(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, percent: int = LINE_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of docs(doc_id long, text string, host column, ...).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words, kept.
    Null or empty text: all counts 0, base_failed. A null host is a host; a null doc_id counts as one document. Repeated
    rows count once for a line and have equal results. Other columns are not read. An empty table gives no row. A text of any length is one row's arrays.
    """
    key = F.when(F.col(host).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(host).cast("string")))
    base = materialize(base_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), key.alias("host"))), "line-rules")
    lines = base.select("host", "doc_id", "text_key", F.explode("lines").alias("x")).select("host", "doc_id", "text_key", F.col("x.h").alias("line"), F.col("x.c").alias("words"))
    lines = lines.groupBy("host", "line", "doc_id", "text_key").agg(F.sum("words").alias("words"))
    lines = materialize(lines, "line-rows")
    of_host = base.groupBy("host", "doc_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    often = lines.groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    often = often.join(of_host, "host").where(F.col("docs") * 100 > F.col("host_docs") * percent).select("host", "line")
    lost = lines.join(materialize(often, "frequent-lines"), ["host", "line"]).groupBy("doc_id", "text_key", "host").agg(F.sum("words").alias("lost"))
    lost = materialize(lost.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), F.col("host").alias("_h"), "lost"), "lost-words")
    out = base.drop("lines").join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")) & (F.col("host") == F.col("_h")), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    gone = F.coalesce("lost", F.lit(0)).cast("long")
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < least_words) | (left * 2 < F.col("n_words")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), gone.alias("removed_words"), (~failed & ~depleted).alias("kept"))


_WS = r"[\x20\x09-\x0D]"
_RULES_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS c,
        trim(regexp_replace(translate(line, '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D0-9!-/:-@\x5B-\x60{{-~]+', ' ', 'g')) AS n
      FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM d GROUP BY source),
often AS (SELECT l.source, n FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source WHERE n <> '' GROUP BY l.source, n, host_docs
          HAVING count(DISTINCT doc_id) > {LEAST_DOCS} AND count(DISTINCT doc_id) * 100 > host_docs * {LINE_PERCENT}),
lost AS (SELECT doc_id, sum(c) AS lost FROM l JOIN often ON l.source IS NOT DISTINCT FROM often.source AND l.n = often.n GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '{_WS}', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS removed_words
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR n_repeat_words * 100 > n_words * {REPEAT_PERCENT} AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, removed_words::BIGINT AS removed_words,
       NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < {LEAST_WORDS} OR (n_words - removed_words) * 2 < n_words)) AS kept
FROM f
"""
ORACLE = _RULES_SQL
