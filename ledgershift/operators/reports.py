"""Reports as tables: overview, conclusion, labels, document lines, sheets with whole cells, Markdown with every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import markdown_safe
from .explore import chunks
from .numbering import numbered as in_order

#: Characters of a sheet's cell; a longer one goes on in the next part of its record.
CELL = 15_000
#: Items that short reports show.
FIRST_MOVED, FIRST_UNITS, FIRST_CLAIMS = 8, 12, 5
# Short names of units that are known, in sheets and matrices.
SHORT = {
    "департамент ит-аудита и анализа данных": "ДИТААД", "департамент операционного аудита": "ДОА", "департамент непрерывного мониторинга системы внутреннего контроля": "ДНМ",
    "департамент контроля качества аудита и методологии": "ДККМ", "бва (общие функции)": "БВА", "главный аудитор": "ГА", "владелец не установлен": "?",
}
FORMULA = r"\A[=+\-@\t\r]"


def unit_labels(units: DataFrame) -> DataFrame:
    """unit, label of units(ord, unit): a known short name, the name itself if short, else П and its place; a label that is taken becomes П and the place.

    The last rule adds a mark where even that is taken.
    """
    known = F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv))
    rows = in_order(units, "ord", "unit", name="place").withColumn("number", F.concat(F.lit("П"), F.col("place").cast("string")))
    rows = rows.withColumn("want", F.coalesce(known[F.lower("unit")], F.when(F.length("unit") <= 8, F.col("unit")), F.col("number")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("want").orderBy("place")))
    rows = rows.withColumn("label", F.when(F.col("nth") == 1, F.col("want")).otherwise(F.col("number")))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("label").orderBy("place")))
    return rows.select("unit", F.concat("label", F.repeat(F.lit("′"), F.col("again") - 1)).alias("label"))


def document_lines(documents: DataFrame) -> DataFrame:
    """period, line of documents(period, ord, name, edition, protocol, date): the name with what the cover says."""
    details = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{title} "), c)) for c, title in ((F.col("edition"), "редакция №"), (F.col("protocol"), "протокол №"), (F.col("date"), "дата"))))), ", ")
    return documents.select("period", "ord", F.concat("name", F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise("")).alias("line"))


def conclusion(counts: DataFrame) -> DataFrame:
    """text of counts(name, value): one sentence of what was matched, lost, new, doubled and in conflict."""
    n = lambda *names: F.coalesce(F.sum(F.when(F.col("name").isin(*names), F.col("value"))), F.lit(0)).cast("string")
    return counts.agg(F.concat(F.lit("matched "), n("row_preserved", "row_moved", "row_changed"), F.lit(", lost "), n("row_lost"), F.lit(", new "), n("row_new"), F.lit(", duplicates "), n("finding_duplicate"), F.lit(", conflicts "), n("finding_conflict"), F.lit("; all need review")).alias("text"))


def sheet(rows: DataFrame, name: str, key: str, columns: list[str]) -> DataFrame:
    """sheet, key, column, part, parts, value: every cell of a sheet, whole, safe from being read as a formula, in parts of a cell's size."""
    cells = rows.select(F.col(key).cast("string").alias("key"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).unpivot("key", columns, "column", "value")
    plain = F.regexp_replace("value", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    cells = cells.withColumn("value", F.when(plain.rlike(FORMULA), F.concat(F.lit("'"), plain)).otherwise(plain))
    cells = cells.withColumn("cell", F.struct("key", "column"))
    out = chunks(cells, "cell", "value", CELL)
    return out.select(F.lit(name).alias("sheet"), "cell.key", "cell.column", "part", "parts", F.col("chunk").alias("value"))


def markdown(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """finding_no, kind, line: a heading and every source of each finding, escaped. findings: finding_no, title, sources; sources: source_id, locator, text."""
    head = findings.select("finding_no", F.lit(0).alias("kind"), F.lit("").alias("source_id"), F.concat(F.lit("### "), markdown_safe(F.col("title"))).alias("line"))
    item = findings.select("finding_no", F.explode(F.array_distinct("sources")).alias("source_id")).join(sources, "source_id", "left")
    body = item.select("finding_no", F.lit(1).alias("kind"), "source_id", F.concat(F.lit("- "), markdown_safe(F.coalesce("locator", F.lit("?"))), F.lit(": "), markdown_safe(F.coalesce("text", F.lit("source not found")))).alias("line"))
    return head.unionByName(body)


def value_rows(values: DataFrame, known: DataFrame) -> DataFrame:
    """Values as a table shows them: namespace, id, metric by its first name in known(code, name), code, value, unit, scope, period, source, confirmed.

    values: id, metric, value, unit, scope, start, end, synthetic, confirmed, file, sheet, cell, page, locator; of a source
    what is given is joined.
    """
    names = known.groupBy("code").agg(F.min("name").alias("name"))
    some = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    source = F.concat_ws(" · ", some("file"), some("sheet"), some("cell"), F.when(F.col("page") > 0, F.concat(F.lit("p. "), F.col("page").cast("string"))), some("locator"))
    rows = values.join(names, F.col("metric") == F.col("code"), "left")
    label = F.when(F.col("synthetic"), "SYNTHETIC DATA").otherwise("REPORT DATA")
    return rows.select(label.alias("data"), "id", F.coalesce("name", "metric").alias("metric_name"), "metric", "value", "unit", "scope", "start", "end", source.alias("source"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def first_items(rows: DataFrame, by: str, order: list[str | Column], most: int) -> DataFrame:
    """The first `most` rows of each value of `by`."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")


def numbered(rows: DataFrame, prefix: str, order: list[str], name: str = "number") -> DataFrame:
    """rows with an id of the prefix and their place (R1, R2, ...)."""
    return in_order(rows, *order, name=name).withColumn(name, F.concat(F.lit(prefix), F.col(name).cast("string")))


def search_sources(sources: DataFrame, query: str, period: str | None = None) -> DataFrame:
    """sources(source_id, period, document, locator, text) of a period that hold the query anywhere, whatever the case."""
    rows = sources if period is None else sources.where(F.col("period") == period)
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "source_id", "document", "locator", "text")), F.lit(query.lower())))


def filter_matrix(rows: DataFrame, norms: tuple[str, ...], statuses: tuple[str, ...], query: str = "") -> DataFrame:
    """Matrix rows of the chosen norm types and statuses that hold the query in label or owners."""
    text = F.lower(F.concat_ws(" ", "label", "owners_before", "owners_after"))
    return rows.where(F.col("norm_type").isin(*norms) & F.col("status").isin(*statuses) & F.contains(text, F.lit(query.lower())))


def filter_findings(findings: DataFrame, kinds: tuple[str, ...], least: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(shown, hidden counts by kind): findings of the kinds at or above the limit; weaker ones stay counted."""
    rows = findings.where(F.col("kind").isin(*kinds))
    return rows.where(F.col("score") >= least), rows.where(F.col("score") < least).groupBy("kind").agg(F.count("*").alias("hidden"))
