"""KPI tables in cells become values or queued ambiguities: header discovery, three layouts, acceptance rules, conflicts.

cells: file, sheet, table_no, r, c, raw, num, fmt. Everything is set-based on (file, sheet, table_no).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import cell_address, mentioned_periods, scope_evidenced, scope_name, synthetic_files, unit_of_measure
from ..functions.numbers import finite, literal_in, parse_number
from ..functions.periods import MONTHS, is_full_period, let, parse_period
from ..functions.text import label_key
from ..session import materialize
from .catalog import ANY_UNIT, BUDGETS, SHARES
from .claims import first_reason

GRID = ["file", "sheet", "table_no"]
HEADER_WITHIN = 30
# Headings of the columns of a table.
FIELDS = {
    "metric": ("метрика", "метрики", "показатель", "показатели", "показатель период", "metric", "metric code", "код метрики", "код показателя", "наименование", "наименование показателя"),
    "value": ("значение", "value", "факт", "итого"),
    "period": ("период", "отчетный период", "period", "месяц", "год", "квартал", "дата"),
    "scope": ("подразделение", "unit scope", "scope", "отдел", "служба"),
    "unit": ("единица", "единица измерения", "ед измерения", "ед изм", "ед", "measure unit"),
    "period_start": ("period start", "начало периода"),
    "period_end": ("period end", "конец периода"),
    "granularity": ("granularity", "гранулярность", "периодичность"),
}
#: A heading that names the scope, or in tables of metrics without one the unit of measure.
EITHER = ("unit",)
# Sheets that describe a workbook, and lines above a table that name its scope or its period.
METADATA = ("_metadata", "metadata", "метаданные")
SCOPE_LINE = r"(?iU)\A(?:подразделение|unit_scope)\s*[:=|]\s*([^\n|;]+)\z"
PERIOD_LINE = r"(?iU)период|отч[её]т\s+за"
CONTEXT_ROWS = 8


def field_of(raw: Column) -> Column:
    """Which field a heading names, or null."""
    key = label_key(raw)
    out = F.when(key.isin(*EITHER), "scope").otherwise(F.lit(None).cast("string"))
    for name, words in FIELDS.items():
        out = F.when(key.isin(*words), name).otherwise(out)
    return out


def headers(cells: DataFrame, known: DataFrame) -> DataFrame:
    """GRID, header_row, layout (long, wide, transposed): the first of 30 rows with metric and value fields, with periods, or with metric labels.

    known: code, label of the catalogue.
    """
    keys = known.select(label_key(F.col("label")).alias("key")).distinct().withColumn("is_metric", F.lit(True))
    seen = cells.where(F.col("r") <= HEADER_WITHIN).withColumns({"field": field_of(F.col("raw")), "period": parse_period(F.col("raw")), "key": label_key(F.col("raw"))})
    by = seen.join(keys, "key", "left").groupBy(*GRID, "r").agg(
        F.bool_or(F.col("field") == "metric").alias("m"), F.bool_or(F.col("field") == "value").alias("v"), F.bool_or(F.col("field") == "period").alias("p"),
        F.count(F.when((F.col("c") > 1) & F.col("period").isNotNull(), 1)).alias("periods"), F.count(F.when((F.col("c") > 1) & F.col("is_metric"), 1)).alias("metrics"),
    )
    layout = F.when(F.col("m") & F.col("v"), "long").when(F.col("periods") > 0, "wide").when(F.col("metrics") > 0, "transposed")
    by = by.withColumn("layout", layout).where("layout is not null")
    first = Window.partitionBy(*GRID).orderBy("r")
    return by.withColumn("k", F.row_number().over(first)).where("k = 1").select(*GRID, F.col("r").alias("header_row"), "layout")


def records(cells: DataFrame, known: DataFrame) -> DataFrame:
    """One row a value cell: GRID, r, c, label, period_text, scope, unit, raw, fmt, num, quote (the row's cells)."""
    cells = cells.where(~F.lower("sheet").isin(*METADATA))
    head = headers(cells, known).join(contexts(cells), GRID, "left")
    at = cells.join(head, GRID)
    top = at.where("r = header_row").select(*GRID, "c", F.col("raw").alias("heading"))
    body = at.where("r > header_row").join(top, [*GRID, "c"], "left")
    quote = body.groupBy(*GRID, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "raw"))), lambda x: x["raw"]), " | ").alias("quote"))
    none = F.lit(None).cast("string")
    field = field_of(F.col("heading"))
    long = body.where("layout = 'long'").withColumn("field", field).groupBy(*GRID, "r").agg(
        *(F.max(F.when(F.col("field") == f, F.col("raw"))).alias(f) for f in FIELDS), F.max(F.when(F.col("field") == "value", F.col("c"))).alias("c"), F.max(F.when(F.col("field") == "value", F.col("fmt"))).alias("fmt"), F.max(F.when(F.col("field") == "value", F.col("num"))).alias("num"),
    )
    dates = F.when(F.col("period_start").isNotNull() & F.col("period_end").isNotNull(), F.concat_ws("/", "period_start", "period_end", F.lower("granularity")))
    long = long.join(head.select(*GRID, "context_scope", "context_period"), GRID)
    long = long.select(*GRID, "r", "c", F.col("metric").alias("label"), F.coalesce("period", dates, "context_period").alias("period_text"), F.coalesce(F.nullif(F.trim("scope"), F.lit("")), "context_scope").alias("scope"), "unit", F.col("value").alias("raw"), "fmt", "num")
    long = long.where(F.coalesce(field_of(F.col("label")), F.lit("")) != "metric")
    first = body.where("c = 1").select(*GRID, "r", F.col("raw").alias("first"))
    rest = body.where("c > 1 and layout <> 'long' and heading is not null").join(first, [*GRID, "r"])
    wide = F.col("layout") == "wide"
    rest = rest.select(*GRID, "r", "c", F.when(wide, F.col("first")).otherwise(F.col("heading")).alias("label"), F.when(wide, F.col("heading")).otherwise(F.col("first")).alias("period_text"), F.coalesce("context_scope", F.nullif("sheet", F.lit(""))).alias("scope"), none.alias("unit"), "raw", "fmt", "num")
    out = long.unionByName(rest).join(quote, [*GRID, "r"])
    return out.withColumns({"scope": scope_name(F.col("scope")), "cell": F.when(F.col("sheet") == "", F.format_string("R%dC%d", "r", "c")).otherwise(cell_address(F.col("c"), F.col("r")))})


def contexts(cells: DataFrame) -> DataFrame:
    """GRID, context_scope, context_period: what the first rows say of a whole table, where they say one thing only."""
    lines = cells.where(F.col("r") <= CONTEXT_ROWS).groupBy(*GRID, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "raw"))), lambda x: x["raw"]), " | ").alias("line"))
    scope = F.nullif(F.regexp_extract("line", SCOPE_LINE, 1), F.lit(""))
    period = F.when(F.col("line").rlike(PERIOD_LINE) & parse_period(F.col("line")).isNotNull(), F.col("line"))
    one = lines.groupBy(*GRID).agg(F.collect_set(F.trim(scope)).alias("s"), F.collect_set(period).alias("p"))
    return one.select(*GRID, F.when(F.size("s") == 1, F.get("s", 0)).alias("context_scope"), F.when(F.size("p") == 1, F.get("p", 0)).alias("context_period"))


def dated_period(text: Column) -> Column:
    """A period in words, or `start/end` or `start/end/granularity` in ISO days that are one whole month, quarter or year."""
    names = F.create_map(*(F.lit(x) for kv in {"месяц": "month", "квартал": "quarter", "год": "year"}.items() for x in kv))

    def dated(x: Column) -> Column:
        out = F.when(F.lit(False), F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("").alias("granularity")))
        for kind in MONTHS:
            fits = is_full_period(x["start"], x["end"], kind) & (x["said"].isNull() | ~x["said"].isin(*MONTHS) | (x["said"] == kind))
            out = out.when(fits, F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("granularity")))
        return out

    def parts(x: Column) -> Column:
        start, end = (F.try_to_date(F.get(x, i), "yyyy-MM-dd") for i in (0, 1))
        said = F.get(x, 2)
        return F.struct(start.alias("start"), end.alias("end"), F.coalesce(names[said], said).alias("said"))

    return F.coalesce(let(let(F.split(text, "/"), parts), dated), F.when(~F.contains(text, F.lit("/")) | text.rlike(r"^\s*(?:19|20)\d{2}/(?:0?[1-9]|1[0-2])(?:/01)?\s*$"), parse_period(text)))


def accept(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, queue) of records against the catalogue known(code, label, unit): any broken rule queues a record.

    reason is the first broken rule, reasons all of them. An unknown metric gets a custom code from its label, which a
    human has to confirm. The same key with another value queues both (and what follows).
    """
    keys = known.select(label_key(F.col("label")).alias("key"), "code", F.col("unit").alias("metric_unit")).distinct()
    one = keys.groupBy("key").agg(F.collect_set("code").alias("codes"), F.max("metric_unit").alias("metric_unit"))
    rows = found.withColumn("key", label_key(F.col("label"))).join(one, "key", "left")
    rows = rows.withColumns({"n": parse_number(F.col("raw"), F.coalesce("fmt", F.lit("General")), F.col("num")), "p": dated_period(F.col("period_text"))})
    rows = materialize(rows, "parsed-cells")  # what follows uses the parsed number and period many times
    number, code, own = F.col("n.value"), F.get("codes", 0), F.col("metric_unit")
    sign = F.when(F.col("raw").contains("%") | F.coalesce("fmt", F.lit("")).contains("%"), "%")
    given = F.coalesce(F.nullif(unit_of_measure(F.coalesce("unit", F.lit(""))), F.lit("")), sign, F.nullif(F.regexp_extract("raw", r"(?U)^[-+\d.,\s]+(\p{L}[\p{L}./]*)$", 1), F.lit("")))
    given = F.when(given.isNotNull(), unit_of_measure(given))
    said = F.coalesce(F.col("label").contains("%") | (F.col("label") == code) | F.lower("label").rlike("доля|процент"), F.lit(False))
    resolved = F.coalesce(F.size("codes") == 1, F.lit(False))
    rules = dict(
        unknown_metric=F.col("codes").isNull(), ambiguous_metric=F.size("codes") > 1, number=number.isNull(), period=F.col("p").isNull(),
        scope=F.coalesce(F.trim("scope"), F.lit("")) == "", unit_mismatch=resolved & given.isNotNull() & ~code.isin(*ANY_UNIT) & (given != own) & (given != "%") & (own != "%"),
        budget_unit=resolved & code.isin(*BUDGETS) & given.isNull(), bare_percent=resolved & (own == "%") & (F.coalesce(given, F.lit("")) != "%") & ~said,
        percent_of_other=resolved & (own != "%") & (given == "%") & (code != "qa_score"), negative=resolved & (number < 0), over_hundred=resolved & code.isin(*SHARES) & (number > 100),
    )
    reasons = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    rows = rows.withColumns({"reason": first_reason(**rules), "reasons": reasons, "unit": F.coalesce(given, own)})
    custom = F.concat(F.lit("custom_"), F.substring(F.sha2("key", 256), 1, 10))
    rows = rows.withColumn("codes", F.coalesce("codes", F.array(custom)))
    rows = rows.withColumns({"code": F.get("codes", 0), "value": F.col("n.value"), "start": F.col("p.start"), "end": F.col("p.end")})
    ident = F.concat(F.lit("mv_"), F.substring(F.sha2(F.concat_ws("|", *GRID, "r", "c", "code", "scope", F.col("start").cast("string")), 256), 1, 20))
    rows = rows.withColumn("id", ident)
    fine = rows.where("reason is null")
    by = Window.partitionBy("code", "scope", "start", "end")
    ordered = by.orderBy(*GRID, "r", "c")
    fine = fine.withColumns({"first": F.first("value").over(ordered), "k": F.row_number().over(ordered)})
    fine = fine.withColumn("k0", F.min(F.when(F.col("value") != F.col("first"), F.col("k"))).over(by))
    out = ["id", "code", "scope", "start", "end", "value", "unit", "quote"]
    values = fine.where("k0 is null and k = 1").select(*out)
    queue = fine.where("k0 is not null and (k = 1 or k >= k0)").withColumns({"reason": F.lit("conflict"), "reasons": F.array(F.lit("conflict"))}).select(*out, "label", "reason", "reasons")
    queue = queue.unionByName(rows.where("reason is not null").select(*out, "label", "reason", "reasons"))
    return values, queue.withColumn("queue_id", F.concat(F.lit("ma_"), F.substring(F.sha2(F.concat_ws("|", "quote", "label", F.col("value").cast("string"), "reason"), 256), 1, 18)))


def custom_metrics(queue: DataFrame) -> DataFrame:
    """code, label, unit, confirmed of metrics that no catalogue knows: one a label, unconfirmed until a human names them."""
    rows = queue.where(F.col("code").startswith("custom_")).groupBy("code").agg(F.min("label").alias("label"), F.max("unit").alias("unit"))
    return rows.withColumns({"unit": F.coalesce("unit", F.lit("unknown")), "confirmed": F.lit(False)})


def namespace_errors(cells: DataFrame, synthetic: bool) -> DataFrame:
    """file, synthetic of workbooks whose marker differs from the namespace of the run; real and synthetic reports never mix."""
    return synthetic_files(cells).where(F.col("synthetic") != F.lit(synthetic))


def check_extracted(found: DataFrame, fragments: DataFrame, known: DataFrame, supplied: str = "") -> DataFrame:
    """value_id, state, reason of numbers that a model read in fragments(source_id, file, text).

    found: value_id, source_id, quote, value, label, unit_scope, period_start, period_end, granularity, unit. Rejected: no
    such source, a quote that is not in it, a number that is not in the quote. Queued: a period, scope or percent that
    the text does not show, or an unknown or ambiguous metric. The rest is accepted.
    """
    files = fragments.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "text"))), lambda x: x["text"]), "\n").alias("file_text"))
    rows = found.join(fragments, "source_id", "left").join(files, "file", "left")
    keys = known.select(label_key(F.col("label")).alias("key"), "code").distinct().groupBy("key").agg(F.count("*").alias("n_codes"))
    rows = rows.withColumn("key", label_key(F.col("label"))).join(keys, "key", "left")
    rows = materialize(rows.withColumns({"here": mentioned_periods(F.coalesce("text", F.lit(""))), "whole": mentioned_periods(F.coalesce("file_text", F.lit("")))}), "extracted")
    period = F.struct(*(F.try_to_date(F.col(c), "yyyy-MM-dd").alias(n) for c, n in (("period_start", "start"), ("period_end", "end"))), F.col("granularity").alias("granularity"))
    here, whole = F.col("here"), F.col("whole")
    full = F.coalesce(*[F.when(F.col("granularity") == k, is_full_period(period["start"], period["end"], k)) for k in MONTHS], F.lit(False))
    in_text = F.when(F.size(here) > 0, F.array_contains(here, period)).otherwise((F.size(whole) == 1) & F.array_contains(whole, period))
    quoted = F.coalesce((F.length(F.trim("quote")) >= 8) & F.contains("text", "quote"), F.lit(False))
    refused = first_reason(unknown_source=F.col("text").isNull(), quote=~quoted, number=~F.coalesce(finite(F.col("value")) & literal_in(F.col("value"), F.col("quote")), F.lit(False)))
    doubt = first_reason(
        label=F.coalesce(F.trim("label"), F.lit("")) == "", period=~F.coalesce(full & in_text, F.lit(False)), scope=~scope_evidenced(F.col("unit_scope"), F.col("file_text"), F.lit(supplied)),
        percent=(F.col("unit") == "%") & ~F.lower("text").rlike("%|процент|доля"), unknown_metric=F.col("n_codes").isNull(), ambiguous_metric=F.col("n_codes") > 1,
    )
    state = F.when(refused.isNotNull(), "rejected").when(doubt.isNotNull(), "queued").otherwise("accepted")
    return rows.select("value_id", state.alias("state"), F.coalesce(refused, doubt, F.lit("")).alias("reason"))


def confirm(queue: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, queue left) after decisions(id, value) that keep everything but the value; the number must stand in the quote."""
    said = queue.join(decisions.select("id", F.col("value").alias("said")), "id").where(literal_in(F.col("said"), F.col("quote"), grouped=True))
    values = said.select("id", "code", "scope", "start", "end", F.col("said").alias("value"), "quote")
    return values, still_queued(queue, values.select("id"))


def still_queued(queue: DataFrame, confirmed: DataFrame) -> DataFrame:
    """queue without the confirmed ids; one of a conflict takes all conflicts of its key along, and nothing else of that key."""
    key = ["code", "scope", "start", "end"]
    clash = F.col("reason") == "conflict"
    solved = queue.where(clash).join(confirmed.select("id").distinct(), "id", "left_semi").select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return queue.join(confirmed.select("id").distinct(), "id", "left_anti").join(solved, clash & same, "left_anti")


def confirmations(queue: DataFrame, decisions: DataFrame, known: DataFrame) -> DataFrame:
    """id, state, code, scope, start, end, granularity, value, unit, quote of what a human decided, by the order `ord`.

    decisions: ord, id, code, scope, start, end, granularity, value, unit; a null value keeps the proposed one. state is
    the first rule that the decision breaks (unknown_item, number, scope_or_period, metric, custom_metric), `resolved` where an earlier
    one has taken the item or, among conflicts, its key; else `confirmed`. A proposed custom metric needs a unit and a name.
    """
    held = queue.select("id", "quote", "label", "reason", F.col("value").alias("_value"), *(F.col(c).alias(f"_{c}") for c in ("code", "scope", "start", "end")))
    codes = known.groupBy("code").agg(F.max("unit").alias("_unit"))
    rows = decisions.withColumn("value", F.col("value").cast("double")).join(held, "id", "left").join(codes, "code", "left")
    rows = rows.withColumn("value", F.coalesce("value", "_value"))
    full = F.coalesce(*(F.when(F.col("granularity") == k, is_full_period(F.col("start"), F.col("end"), k)) for k in MONTHS), F.lit(False))
    custom = F.coalesce(F.col("code").startswith("custom_"), F.lit(False))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    listed = F.col("_unit").isNotNull() | (custom & F.coalesce(F.col("code") == F.col("_code"), F.lit(False)))
    state = first_reason(
        unknown_item=F.col("reason").isNull(), number=~F.coalesce(finite(F.col("value")) & literal_in(F.col("value"), F.col("quote"), grouped=True), F.lit(False)),
        scope_or_period=blank("scope") | ~full, metric=~listed, custom_metric=custom & (blank("unit") | blank("label")),
    )
    rows = rows.withColumns({"state": state, "unit": F.when(blank("unit"), F.col("_unit")).otherwise(F.col("unit")), "scope": scope_name(F.col("scope"))})
    once = F.when(F.col("reason") == "conflict", F.to_json(F.struct("_code", "_scope", "_start", "_end"), {"ignoreNullFields": "false"})).otherwise(F.concat(F.lit("id "), F.col("id")))
    first = F.min(F.when(F.col("state").isNull(), F.col("ord"))).over(Window.partitionBy("once"))
    rows = rows.withColumn("once", once).withColumn("first", first)
    late = F.col("reason").isNotNull() & (F.col("ord") > F.col("first"))
    state = F.when(late, "resolved").otherwise(F.coalesce("state", F.lit("confirmed")))
    return rows.select("ord", "id", state.alias("state"), "code", "scope", "start", "end", "granularity", "value", "unit", "quote")
