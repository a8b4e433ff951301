"""Measures in reports as Column functions: units, scopes, cell addresses, grounded numbers, periods that a text mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import close
from .periods import ORDERS, parse_period
from .text import label_key

# Spellings of units of measure, and Latin names of units of an organisation with their canonical ones.
UNITS = (("дни", r"дн(?:ей|я)?\.?|день|дни"), ("шт.", r"шт\.?|ед\.?|штук"), ("чел.", r"чел\.?|человек"), ("FTE", "fte"), ("баллы", r"балл\w*"))
SCOPES = {"DNM": "ДНМ", "DKKM": "ДККМ", "DITAAD": "ДИТААД", "DOA": "ДОА", "BVA": "BVA", "БВА": "BVA"}
# Roots in a function's wording and the metric that they suggest.
SUGGESTED = (("отчет", "report_delay_days"), ("качеств", "qa_score"), ("покрыти", "assurance_coverage"), ("карта гарантий", "assurance_coverage"), ("проверк", "audits_done"), ("аудит", "audits_done"), ("мероприяти", "action_overdue"))
# Score metrics that are shown in percent.
PERCENT_METRICS = ("strongest_weighted_match", "nearest_text_similarity", "action_overlap", "object_overlap", "match_coverage", "text_similarity", "reported_score", "raw_score", "score_cap")
_NUMBER = r"(?<![\p{L}\p{N}_])[-+]?\d+(?:[.,]\d+)?(?:[eE][-+]?\d+)?"
# Fixed value: how a text names the year of a report.
_YEAR_SAID = r"(?iU)(?:за|в|период|отч[её]т\s+за)\s*[:=|]?\s*((?:19|20)\d{2})(?![-/.\d])\s*(?:год\w*|г\.)?"


def unit_of_measure(text: Column) -> Column:
    """A unit's canonical spelling, else the text trimmed."""
    t, out = F.lower(F.trim(text)), F.when(F.lit(False), "")
    for name, pattern in UNITS:
        out = out.when(t.rlike(rf"(?U)\A(?:{pattern})\z"), name)
    return out.otherwise(F.trim(text))


def scope_name(text: Column) -> Column:
    """A scope's canonical name; unknown ones stay, trimmed."""
    names = F.create_map(*(F.lit(x) for kv in SCOPES.items() for x in kv))
    return F.coalesce(names[F.upper(F.trim(text))], F.trim(text))


def scope_evidenced(scope: Column, text: Column, supplied: Column) -> Column:
    """Whether a scope is the one that the user chose, or stands in the text under one of its names."""
    padded = F.concat(F.lit(" "), label_key(text), F.lit(" "))
    aliases = F.array_distinct(F.concat(F.array(scope), F.array_compact(F.array(*(F.when(scope == name, F.lit(alias)) for alias, name in SCOPES.items())))))
    said = F.exists(aliases, lambda a: F.contains(padded, F.concat(F.lit(" "), label_key(a), F.lit(" "))))
    chosen = (F.coalesce(supplied, F.lit("")) != "") & (scope_name(scope) == scope_name(supplied))
    return F.coalesce(chosen, F.lit(False)) | (F.coalesce(scope != "", F.lit(False)) & F.coalesce(said, F.lit(False)))


def cell_address(column: Column, row: Column) -> Column:
    """A1 style address of a cell in the first 702 columns."""
    letter = lambda n: F.char(F.lit(65) + n)
    first = F.floor((column - 1) / 26)
    return F.concat(F.when(first > 0, letter(first - 1)).otherwise(""), letter((column - 1) % 26), row.cast("string"))


def numbers(text: Column) -> Column:
    """The numbers written in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(_NUMBER), 0), lambda x: F.regexp_replace(x, ",", ".").cast("double"))


def numbers_grounded(text: Column, facts: Column) -> Column:
    """Whether each number in text is one of those in facts, up to display rounding."""
    known = numbers(facts)
    return F.forall(numbers(text), lambda x: F.exists(known, lambda k: close(x, k, 0.0005, 0.005)))


def mentioned_periods(text: Column) -> Column:
    """The set of reporting periods that lines of a text name; lines on approvals and orders do not count."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(f"(?iU){ORDERS}"))
    years = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(_YEAR_SAID), 1)))
    return F.array_distinct(F.array_compact(F.transform(F.concat(lines, years), parse_period)))


def suggested_metrics(text: Column) -> Column:
    """Metrics that a function's wording suggests, in a fixed order."""
    t = F.replace(F.lower(text), F.lit("ё"), F.lit("е"))
    return F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(t, F.lit(root)), F.lit(metric)) for root, metric in SUGGESTED))))


def shown_metric(name: Column, value: Column) -> Column:
    """A score's metric as shown: percent, yes or no, or as it is; value is text."""
    share = F.concat(F.round(value.cast("double") * 100).cast("long").cast("string"), F.lit("%"))
    return F.when(name.isin(*PERCENT_METRICS), share).when(value == "true", "yes").when(value == "false", "no").otherwise(value)


# Fixed value: what marks a report as synthetic, in a row's cells.
SYNTHETIC = r"(?iU)ТЕСТОВЫЕ ДАННЫЕ|is_synthetic\s*[|:=]\s*(?:true|1)"


def synthetic_files(cells: DataFrame) -> DataFrame:
    """file, synthetic of cells(file, sheet, table_no, r, c, raw): whether any row says that the report is synthetic."""
    cell = F.array_sort(F.collect_list(F.struct("c", F.coalesce("raw", F.lit("")).alias("raw"))))
    rows = cells.groupBy("file", "sheet", "table_no", "r").agg(F.array_join(F.transform(cell, lambda x: x["raw"]), " | ").alias("row"))
    return rows.groupBy("file").agg(F.bool_or(F.col("row").rlike(SYNTHETIC)).alias("synthetic"))
