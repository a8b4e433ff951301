"""Cases of the document, KPI and review rules: small tables, and the rows that the rules ask for, stated as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgershift.functions import measures as Me
from ledgershift.functions import text as T
from ledgershift.functions.periods import is_full_period
from ledgershift.operators import assignments as A
from ledgershift.operators import catalog as K
from ledgershift.operators import compare as C
from ledgershift.operators import explore as X
from ledgershift.operators import findings as Fi
from ledgershift.operators import ingest as I
from ledgershift.operators import matching as M
from ledgershift.operators import reports as R
from ledgershift.operators import review as V
from ledgershift.operators import runs as U
from ledgershift.operators import scoring as S
from ledgershift.session import ship
from ledgershift.sources import lines as L
from ledgershift.sources import office as O
from ledgershift.sources import pages as P

RULES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def query(sql: str, dates: tuple[str, ...] = ()) -> Callable:
    """A case under its function's name, with the rows that it must give; columns in `dates` are given as ISO text."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        RULES[f.__name__] = (lambda spark, _: f(spark, _).withColumns({c: F.col(c).cast("string") for c in dates})) if dates else f
        EXPECTED[f.__name__] = sql
        return f

    return add


_LINES = "package string, document_no int, document string, line_no int, frag_id string, text string"


def _values(columns: str, *rows: str) -> str:
    """SQL for stated rows; numbers with a point are doubles."""

    def doubles(row: str) -> str:
        return "'".join(part if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1::DOUBLE", part) for i, part in enumerate(row.split("'")))

    return f"SELECT * FROM (VALUES {', '.join(f'({doubles(r)})' for r in rows)}) AS t({columns})"


def _lines(spark: SparkSession, packages: dict[str, list[list[str]]]) -> DataFrame:
    ship(spark)
    rows = [(p, d, f"doc{d}", i, f"{p}:{d}:{i}", text) for p, docs in packages.items() for d, lines in enumerate(docs) for i, text in enumerate(lines, 1)]
    return spark.createDataFrame(rows, _LINES)


_LIST = "1.1. Служба состоит из следующих структурных подразделений:"
CASES = {
    "catalogue": [[_LIST, "а) Департамент закупок и логистики (ДЗЛ);", "б) Департамент продаж (ДП)."]],
    "staff_list": [["1. Общее", "2. Департамент закупок:", "2.1. В состав входят следующие должности:", "а) директор по закупкам;", "б) менеджер по договорам.", "2.2. Осуществляет контроль исполнения договоров поставки."]],
    "two_owners": [[_LIST, "а) Департамент закупок (ДЗЛ);", "б) Департамент продаж (ДПР).", "5. Функции", "5.1. ДЗЛ и ДПР:", "5.1.1. проводят сверку складских остатков;"]],
    "list_items": [[_LIST, "а) Департамент закупок (ДЗЛ);", "5. Функции", "5.2. Департамент закупок проводит проверку:", "а) договоров поставки материалов;", "б) складских остатков сырья."]],
    "no_right": [[_LIST, "а) Департамент закупок (ДЗЛ);", "5. Права", "5.3. Департамент закупок не имеет права:", "5.3.1. согласовывать собственные договоры поставки;"]],
    "definitions": [["УТВЕРЖДЕНО приказом, обеспечивает всё", "1. Термины и определения", "Контроль обеспечивает порядок на складе.", "2. Функции", "2.1. Департамент закупок обеспечивает хранение материалов, проводит сверку остатков и готовит отчёт о запасах."]],
    "next_section": [[_LIST, "а) Департамент закупок;", "5. Функции", "5.1. Департамент закупок:", "5.1.1. проводит отбор поставщиков сырья;", "6. Прочее", "6.1. проводит сверку складских остатков."]],
    "next_document": [["1. Функции", "2.1. Департамент закупок обеспечивает хранение материалов."], ["3.1. обеспечение учета складских запасов."]],
}
BEFORE = [
    _LIST, "а) Департамент закупок;", "б) Департамент складского учета;", "5. Функции",
    "5.1. Департамент закупок проводит отбор поставщиков сырья и материалов.", "5.2. Департамент закупок ведет реестр договоров поставки оборудования.",
    "5.3. Департамент складского учета обеспечивает хранение готовой продукции на складе.", "5.4. Департамент складского учета готовит ежемесячный отчет об остатках сырья.",
    "5.5. Департамент складского учета организует аттестацию кладовщиков.",
]
AFTER = [
    _LIST, "а) Департамент закупок;", "б) Департамент логистики и хранения;", "5. Функции",
    "5.1. Департамент закупок проводит отбор поставщиков сырья и материалов.", "5.2. Департамент логистики и хранения ведет реестр договоров поставки оборудования.",
    "5.3. Департамент логистики и хранения обеспечивает хранение готовой продукции на складе.", "5.4. Департамент логистики и хранения готовит ежемесячный отчет об остатках сырья.",
    "5.5. Департамент закупок готовит ежемесячный отчет об остатках сырья.", "5.6. Департамент закупок выполняет приемку импортного оборудования от перевозчика.",
    "5.7. Департамент закупок проводит проверку приемки импортного оборудования от перевозчика.",
]


@query(_values(
    "package, unit, norm_type, role, text",
    "'staff_list', 'Департамент закупок', 'duty', 'execute', 'Осуществляет контроль исполнения договоров поставки.'",
    "'two_owners', 'Департамент закупок', 'duty', 'execute', 'проводят сверку складских остатков'", "'two_owners', 'Департамент продаж', 'duty', 'execute', 'проводят сверку складских остатков'",
    "'list_items', 'Департамент закупок', 'duty', 'control', 'договоров поставки материалов'", "'list_items', 'Департамент закупок', 'duty', 'control', 'складских остатков сырья.'",
    "'no_right', 'Департамент закупок', 'prohibition', 'agree', 'согласовывать собственные договоры поставки'",
    "'definitions', 'Департамент закупок', 'duty', 'execute', 'обеспечивает хранение материалов'", "'definitions', 'Департамент закупок', 'duty', 'execute', 'проводит сверку остатков'", "'definitions', 'Департамент закупок', 'duty', 'execute', 'готовит отчёт о запасах.'",
    "'next_section', 'Департамент закупок', 'duty', 'execute', 'проводит отбор поставщиков сырья'", "'next_section', 'Владелец не установлен', 'duty', 'execute', 'проводит сверку складских остатков.'",
    "'next_document', 'Департамент закупок', 'duty', 'execute', 'обеспечивает хранение материалов.'",
))
def assignment_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assignments(A.scan(_lines(spark, CASES))).select("package", "unit", "norm_type", "role", "text")


@query(_values("package, unit, aliases", "'catalogue', 'Департамент закупок и логистики', 'ДЗЛ'", "'catalogue', 'Департамент продаж', 'ДП'", "'two_owners', 'Департамент закупок', 'ДЗЛ'", "'two_owners', 'Департамент продаж', 'ДПР'"))
def unit_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = {k: CASES[k] for k in ("catalogue", "two_owners")}
    return A.units(A.scan(_lines(spark, cases))).select("package", "unit", F.array_join("aliases", ",").alias("aliases"))


def _pair(spark: SparkSession, before: list[str] = BEFORE, after: list[str] = AFTER) -> tuple[DataFrame, DataFrame]:
    scanned = A.scan(_lines(spark, {"before": [before], "after": [after]}))
    return A.assignments(scanned), A.units(scanned)


@query(_values("finding_no, kind, title, score, level", "1, 'loss', 'owner_not_found', 0.89, 'high'", "2, 'duplicate', 'overlap', 0.89, 'high'", "3, 'conflict', 'execution_and_control', 0.89, 'high'"))
def comparison_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, _ = _pair(spark)
    rows, members = Fi.matrix(assigned)
    return Fi.findings(assigned, rows, members, Fi.package_state(assigned)).select("finding_no", "kind", "title", "score", "level")


@query(_values(
    "label, status, owners, overlap", "'обеспечивает хранение готовой продукции на складе.', 'moved', 2, false", "'ведет реестр договоров поставки оборудования.', 'moved', 2, false",
    "'готовит ежемесячный отчет об остатках сырья.', 'moved', 3, true", "'проводит отбор поставщиков сырья и материалов.', 'preserved', 2, false", "'организует аттестацию кладовщиков.', 'lost', 1, false",
    "'выполняет приемку импортного оборудования от перевозчика.', 'new', 1, false", "'проводит проверку приемки импортного оборудования от перевозчика.', 'new', 1, false",
))
def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = Fi.matrix(_pair(spark)[0])
    return rows.select("label", "status", (F.size("owners_before") + F.size("owners_after")).alias("owners"), F.col("candidate_overlap").alias("overlap"))


@query(_values("side, outcome, n", "'before', 'present', 5", "'before', 'not_listed', 7", "'before', 'none', 9", "'after', 'added', 6", "'after', 'present', 1", "'after', 'overlap', 0", "'after', 'missing', 1", "'after', 'moved_away', 3", "'after', 'not_listed', 4", "'after', 'none', 6") + " WHERE n > 0")
def comparison_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, units = _pair(spark)
    rows, members = Fi.matrix(assigned)
    return Fi.cells(rows, members, units.select("unit", F.col("package").alias("side"))).groupBy("side", "outcome").agg(F.count("*").cast("int").alias("n"))


@query(_values("before, after, status", "'Департамент закупок', 'Департамент закупок', 'preserved'", "'Департамент складского учета', 'Департамент хранения и запасов', 'transformed'"))
def comparison_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = [x.replace("складского учета", "хранения и запасов") for x in BEFORE]
    assigned, units = _pair(spark, BEFORE, after)
    return Fi.unit_changes(units, assigned).select("before", "after", "status")


@query(_values("status, split, n_after", "'moved', true, 2", "'preserved', false, 1"))
def split_duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = [_LIST, "а) Департамент закупок;", "б) Департамент логистики;", "5. Функции", "5.1. Департамент закупок ведет реестр договоров поставки оборудования."]
    old = [*head, "5.2. Департамент закупок осуществляет подготовку и согласование заявок складского резерва сырья."]
    new = [*head, "5.2. Департамент закупок осуществляет подготовку заявок складского резерва филиалов.", "5.3. Департамент логистики осуществляет согласование заявок складского резерва площадок."]
    rows, members = Fi.matrix(_pair(spark, [*old], [*new])[0])
    n = members.where("period = 'after'").groupBy("row_ord").agg(F.count("*").cast("int").alias("n_after"))
    return rows.join(n, "row_ord").select("status", "split", "n_after")


@query(_values(
    "k, norm_type, role, tokens, first_at", "1, 'prohibition', 'execute', 3, 3", "2, 'right', 'execute', 6, 12", "3, 'duty', 'execute', 4, 7", "4, 'duty', 'control', 3, 0", "5, 'duty', 'agree', 4, 13", "6, 'duty', 'execute', 3, 13",
))
def regulation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "не осуществляет проверку собственных договоров"), (2, "имеет право запрашивать документы складского учета"), (3, "обязан хранить документы склада"), (4, "проводит проверку складских договоров"), (5, "обсуждение и согласование складских договоров"), (6, "неконтроль и контроль складов")]
    text = F.col("text")
    found = spark.createDataFrame(rows, "k int, text string").select("k", T.norm_type(text, F.lit("duty")).alias("norm_type"), T.role(text).alias("role"), F.size(T.tokens(text)).alias("tokens"), T.first_action(text)["at"].alias("first_at"))
    return found


@query(_values("k, parts", "1, 'обеспечивает учет | проводит сверку | готовит отчет'", "2, 'Отдел, проводит сверку'", "3, 'ведет реестр | хранит договоры'"))
def predicate_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "обеспечивает учет, проводит сверку и готовит отчет"), (2, "Отдел, проводит сверку"), (3, "ведет реестр; хранит договоры;")]
    return spark.createDataFrame(rows, "k int, text string").select("k", F.array_join(T.split_actions(F.col("text")), " | ").alias("parts"))


@query(_values("k, name, generic", "1, 'Департамент закупок', false", "2, 'Отдел учета', false", "3, 'выполнение прочих поручений руководства', true"))
def unit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Департамент  закупок (ДЗ) — ведет учет"), (2, "Отдел учета не имеет права подписи"), (3, "выполнение прочих поручений руководства")]
    return spark.createDataFrame(rows, "k int, text string").select("k", T.unit_name(F.col("text")).alias("name"), T.is_generic(F.col("text")).alias("generic"))


@query(_values("k, s", "1, 1.0", "2, 0.0", "3, 0.842092"))
def composite_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.createDataFrame([(1, "5.1. Ведение реестра;", "6.2. ведение реестра"), (2, "", "реестр"), (3, "реестр договоров поставки", "реестр договоров поставки сырья")], "k int, a string, b string")
    a, b = T.body(F.col("a")), T.body(F.col("b"))
    rows = rows.select("k", T.norm(a).alias("na"), T.norm(b).alias("nb"), T.tokens(a).alias("ta"), T.tokens(b).alias("tb"))
    return rows.select("k", F.round(T.similarity(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb")), 6).alias("s"))


@query(_values("k, s", "1, 1.0", "2, 0.0", "3, 0.0"))
def guarded_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal duties; another first action, far apart; another first action, the same objects but under .70."""
    rows = [(1, "хранение складских запасов сырья", "хранение складских запасов сырья"), (2, "хранение складских запасов сырья", "подготовка отчета о перевозке"), (3, "хранение складских запасов сырья", "проверка складских запасов сырья")]
    ship(spark)
    both = spark.createDataFrame([(k * 10 + i, text) for k, *pair in rows for i, text in enumerate(pair)], "fn_ord int, text string")
    ready = M.prepared(both)
    pairs = M.side(ready.where("fn_ord % 10 = 0"), "a").withColumn("k", (F.col("a_ord") / 10).cast("int")).join(M.side(ready.where("fn_ord % 10 = 1"), "b").withColumn("k", ((F.col("b_ord") - 1) / 10).cast("int")), "k")
    pairs = pairs.withColumn("s", T.similarity(F.col("a_n"), F.col("b_n"), F.col("a_t"), F.col("b_t")))
    return pairs.select("k", F.round(M.guarded(), 6).alias("s"))


@query(_values("k, score", "'loss', 0.8", "'loss_unknown', 0.39", "'match', 0.99", "'match_dirty', 0.69", "'duplicate', 0.78", "'conflict', 0.65", "'reported', 0.89"))
def finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    scores = {
        "loss": S.loss_score(lit(0.5), lit(True), lit(1.0), lit(True), lit(False), lit(True), lit(False), lit(False), lit(False)),
        "loss_unknown": S.loss_score(lit(0.0), lit(False), lit(1.0), lit(True), lit(True), lit(True), lit(False), lit(False), lit(False)),
        "match": S.match_score(lit(1.0), lit(1.0), lit(True), lit(True), lit(False)), "match_dirty": S.match_score(lit(1.0), lit(1.0), lit(True), lit(False), lit(False)),
        "duplicate": S.duplicate_score(lit(0.8), lit(1.0), lit(0.5), lit(""), lit(""), lit(False), lit(True)), "conflict": S.conflict_score(lit(0.4), lit(True), lit(""), lit("")), "reported": S.reported_score(lit(0.97)),
    }
    return spark.range(1).select(*(x.alias(k) for k, x in scores.items())).unpivot([], list(scores), "k", "score")


@query(_values("k, found", "1, 1", "2, 3", "3, 1"))
def clause_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "См. пункт 5.3. настоящего положения"), (2, "Общее. 5.3. Первое. 5.4. Второе"), (3, "без номеров")]
    return spark.createDataFrame(rows, "k int, text string").select("k", F.size(L.clause_spans(F.col("text"))).alias("found"))


@query(_values("k, whole", "1, true", "2, false", "3, true", "4, false"))
def whole_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, date(2024, 2, 1), date(2024, 2, 29), "month"), (2, date(2023, 2, 1), date(2023, 2, 27), "month"), (3, date(2023, 4, 1), date(2023, 6, 30), "quarter"), (4, date(2023, 2, 1), date(2023, 4, 30), "quarter")]
    df = spark.createDataFrame(rows, "k int, a date, b date, g string")
    return df.select("k", F.when(F.col("g") == "month", is_full_period(F.col("a"), F.col("b"), "month")).otherwise(is_full_period(F.col("a"), F.col("b"), "quarter")).alias("whole"))


@query(_values("k, unit, scope, cell", "1, 'дни', 'ДНМ', 'A1'", "2, 'шт.', 'ДОА', 'Z7'", "3, 'FTE', 'Отдел', 'AB12'", "4, 'тенге', 'BVA', 'GR3'"))
def measure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "дней", "dnm", 1, 1), (2, "ед.", " DOA", 26, 7), (3, "fte", "Отдел", 28, 12), (4, " тенге", "БВА", 200, 3)]
    df = spark.createDataFrame(rows, "k int, u string, s string, c int, r int")
    return df.select("k", Me.unit_of_measure(F.col("u")).alias("unit"), Me.scope_name(F.col("s")).alias("scope"), Me.cell_address(F.col("c"), F.col("r")).alias("cell"))


@query(_values("k, grounded, fine, evidenced", "1, true, true, true", "2, false, true, false", "3, true, false, true"))
def wording_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "рост на 12,5 до 40", "12.5 и 40,002", "ДНМ", "отчет DNM за год", ""), (2, "рост на 13", "12.5", "ДОА", "отчет ДНМ", ""), (3, "это привело к росту", "", "ДОА", "", "doa")]
    df = spark.createDataFrame(rows, "k int, said string, facts string, scope string, text string, chosen string")
    return df.select("k", Me.numbers_grounded(F.col("said"), F.col("facts")).alias("grounded"), T.plain_text_ok(F.col("said")).alias("fine"), Me.scope_evidenced(F.col("scope"), F.col("text"), F.col("chosen")).alias("evidenced"))


@query(_values("k, periods", "1, 1", "2, 2", "3, 0"))
def text_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Отчёт\nза 2023 год"), (2, "Q1 2023\nпериод 2022 года"), (3, "утверждено приказом за 2021 год")]
    return spark.createDataFrame(rows, "k int, text string").select("k", F.size(Me.mentioned_periods(F.col("text"))).alias("periods"))


@query(_values("k, metrics", "1, 'report_delay_days'", "2, 'qa_score audits_done'", "3, ''"))
def metric_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "сдаёт отчёт в срок"), (2, "проверки качества"), (3, "хранит сырьё")]
    return spark.createDataFrame(rows, "k int, text string").select("k", F.array_join(Me.suggested_metrics(F.col("text")), " ").alias("metrics"))


_BAD = (
    ("Нечто", "5", "2023", "ДНМ", "шт."), ("twin", "5", "2023", "ДНМ", ""), ("audits_done", "=A1", "2023", "ДНМ", "шт."), ("audits_done", "5", "2023-02-15", "ДНМ", "шт."), ("audits_done", "5", "2022", "", "шт."),
    ("audits_done", "5", "2021", "ДНМ", "дней"), ("budget_fact", "5", "2023", "ДНМ", ""), ("Выполнение плана работ", "8", "2023", "ДНМ", ""), ("audits_done", "5", "2020", "ДНМ", "%"), ("audits_done", "-5", "2019", "ДНМ", "шт."),
    ("recs_accepted", "101", "2023", "ДНМ", "%"), ("audits_done", "7", "2018", "ДНМ", "шт."), ("audits_done", "8", "2018", "ДНМ", "шт."), ("qa_score", "80", "2018", "ДНМ", "баллов"),
)


def _grid(spark: SparkSession, rows: list[tuple[str, ...]], sheet: str = "S") -> DataFrame:
    cells = [("f.xlsx", sheet, 1, r, c, raw, None, "General") for r, row in enumerate(rows, 1) for c, raw in enumerate(row, 1) if raw != ""]
    return spark.createDataFrame(cells, "file string, sheet string, table_no int, r int, c int, raw string, num double, fmt string")


@query(_values(
    "reason, n", "'unknown_metric', 1", "'ambiguous_metric', 1", "'number', 1", "'period', 1", "'scope', 1", "'unit_mismatch', 1", "'budget_unit', 1", "'bare_percent', 1", "'percent_of_other', 1", "'negative', 1", "'over_hundred', 1", "'conflict', 2", "'accepted', 1",
))
def kpi_ingest_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    twins = spark.createDataFrame([(c, "twin", "шт.", "up", "sum", None) for c in ("twin_a", "twin_b")], K.catalogue(spark).schema)
    known = K.catalogue(spark).unionByName(twins)
    values, queue = I.accept(I.records(_grid(spark, [("Показатель", "Значение", "Период", "Подразделение", "Единица измерения"), *_BAD]), known), known)
    return queue.select("reason").unionByName(values.select(F.lit("accepted").alias("reason"))).groupBy("reason").agg(F.count("*").cast("int").alias("n"))


@query(_values("code, confirmed, n", "'custom', false, 1"))
def kpi_custom_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = K.catalogue(spark)
    _, queue = I.accept(I.records(_grid(spark, [("Показатель", "Значение", "Период", "Подразделение", "Единица измерения"), _BAD[0], ("нечто", "6", "2022", "ДНМ", "шт.")]), known), known)
    return I.custom_metrics(queue).groupBy(F.split("code", "_")[0].alias("code"), "confirmed").agg(F.count("*").cast("int").alias("n"))


@query(_values("cell, scope, start, value", "'C3', 'ДОА', '2023-01-01', 5.0", "'D3', 'ДОА', '2023-04-01', 7.0"))
def kpi_wide_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = K.catalogue(spark)
    cells = _grid(spark, [("Подразделение: DOA",), ("", "", "1 кв. 2023", "Q2 2023"), ("audits_done", "", "5", "7")]).where("not (r = 1 and c > 1)")
    values, _ = I.accept(I.records(cells, known), known)
    return I.records(cells, known).join(values.select("id", "value", "start", "quote"), "quote").where(F.col("raw").cast("double") == F.col("value")).select("cell", "scope", F.col("start").cast("string").alias("start"), "value")


@query(_values(
    "value_id, state, reason", "1, 'accepted', ''", "2, 'rejected', 'unknown_source'", "3, 'rejected', 'quote'", "4, 'rejected', 'number'", "5, 'queued', 'period'", "6, 'queued', 'scope'", "7, 'queued', 'unknown_metric'",
))
def kpi_extracted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fragments = spark.createDataFrame([("s1", "a.docx", "За 2023 год ДНМ: проведено проверок 12, рекомендаций 30.")], "source_id string, file string, text string")
    quote = "проведено проверок 12"
    base = ("s1", quote, 12.0, "Проверок проведено", "ДНМ", "2023-01-01", "2023-12-31", "year", "шт.")
    change = lambda k, **x: (k, *(x.get(n, v) for n, v in zip(("source_id", "quote", "value", "label", "unit_scope", "period_start", "period_end", "granularity", "unit"), base, strict=True)))
    rows = [change(1), change(2, source_id="s9"), change(3, quote="проведено проверок 13"), change(4, value=99.0), change(5, period_start="2022-01-01", period_end="2022-12-31"), change(6, unit_scope="ДОА"), change(7, label="Нечто")]
    found = spark.createDataFrame(rows, "value_id int, source_id string, quote string, value double, label string, unit_scope string, period_start string, period_end string, granularity string, unit string")
    return I.check_extracted(found, fragments, K.catalogue(spark))


def _series(spark: SparkSession, cut: int = 2) -> DataFrame:
    rows = [("delay", scope, date(2022, m, 1), float(a)) for scope, a in (("x", 10), ("y", 5)) for m in (1, 2)]
    rows += [("delay", scope, date(2023, m, 1), float(b)) for scope, b in (("x", 15), ("y", 8)) for m in (1, 2)]
    return spark.createDataFrame(rows, "metric string, scope string, start date, value double").withColumn("end", F.last_day("start"))


@query(_values("variant, method, adjusted_delta", "'clean', 'diff_in_diff', 2.0", "'other_event', 'simple', NULL", "'later_event', 'diff_in_diff', 2.0", "'other_unit', 'simple', NULL", "'unverified', 'simple', NULL"))
def cmp_contaminated_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _series(spark)
    one = ("E1", date(2022, 12, 23), ["x"], ["delay"])
    other = lambda day: ("E2", day, ["y"], ["delay"])
    schema = "event_id string, effective date, units array<string>, metric_codes array<string>"
    control = lambda ok: spark.createDataFrame([("E1", "x", "y", ok, "stable")], "event_id string, scope string, control_scope string, verified boolean, reason string")
    units = lambda u: spark.createDataFrame([("delay", "x", "KZT"), ("delay", "y", u)], "metric string, scope string, unit string")
    variants = {"clean": ([one], True, "KZT"), "other_event": ([one, other(date(2023, 1, 10))], True, "KZT"), "later_event": ([one, other(date(2023, 6, 1))], True, "KZT"), "other_unit": ([one], True, "USD"), "unverified": ([one], False, "KZT")}
    out = None
    for name, (events, ok, unit) in variants.items():
        some = C.compare(points, spark.createDataFrame(events, schema), control(ok), units=units(unit)).where("event_id = 'E1' and scope = 'x'").select(F.lit(name).alias("variant"), "method", "adjusted_delta")
        out = some if out is None else out.unionByName(some)
    return out


_SOURCES = [("b1", "before", "Департамент закупок ведет реестр договоров"), ("b2", "before", "не имеет права согласовывать договоры"), ("a1", "after", "Департамент продаж ведет реестр договоров"), ("a2", "after", "Отдел учета ведет реестр договоров"), ("a3", "after", "не имеет права вести реестр договоров")]


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SOURCES, "source_id string, period string, text string")


@query(_values(
    "risk_id, reason, score", "1, 'accepted', 0.89", "2, 'one_sided_loss', NULL", "3, 'single_source', NULL", "4, 'quote', NULL", "5, 'unknown_source', NULL", "6, 'confidence', NULL", "7, 'only_prohibitions', NULL", "8, 'prohibitions', NULL", "9, 'kind', NULL",
))
def risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = {k: text for k, _, text in _SOURCES} | {"zz": "совсем другой текст"}
    ev = lambda *ids: [(i, said[i]) for i in ids]
    row = lambda k, kind, evidence, c=0.95: (k, kind, "Пропала обязанность", "Пояснение", "Проверить", c, evidence)
    rows = [row(1, "loss", ev("b1", "a1")), row(2, "loss", ev("b1")), row(3, "duplicate", ev("a1")), row(4, "duplicate", [("a1", "нет такой цитаты"), ("a2", said["a2"])]), row(5, "duplicate", ev("a1", "a2", "zz")), row(6, "duplicate", ev("a1", "a2"), 1.5), row(7, "loss", ev("b2", "a1")), row(8, "conflict", ev("a1", "a3")), row(9, "other", ev("a1", "a2"))]
    risks = spark.createDataFrame(rows, "risk_id int, kind string, title string, explanation string, recommendation string, confidence double, evidence array<struct<source_id: string, quote: string>>")
    forbids = spark.createDataFrame([("b2",), ("a3",)], "source_id string")
    return V.check_risks(risks, _sources(spark), forbids).select("risk_id", "reason", "score")


@query(_values("run, status, approved, rejected", "'all', 'completed', 1, 1", "'missing', 'failed', 0, 0", "'extra', 'failed', 0, 0", "'twice', 'failed', 0, 0", "'blank', 'failed', 0, 0"))
def verdict_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ("all", "missing", "extra", "twice", "blank")
    claims = spark.createDataFrame([(r, c) for r in runs for c in ("C0", "F0")], "run string, claim_id string")
    ok, no = ("approve", "so it is"), ("reject", "no proof")
    rows = [("all", "C0", *ok), ("all", "F0", *no), ("missing", "C0", *ok), ("extra", "C0", *ok), ("extra", "F0", *ok), ("extra", "C9", *ok), ("twice", "C0", *ok), ("twice", "C0", *ok), ("twice", "F0", *ok), ("blank", "C0", *ok), ("blank", "F0", "approve", " ")]
    out = V.check_verdicts(claims, spark.createDataFrame(rows, "run string, claim_id string, verdict string, reason string"))
    return out.select("run", "status", F.col("approved").cast("int").alias("approved"), F.col("rejected").cast("int").alias("rejected"))


@query(_values("run, source_id, sent, failed", "'a', 's1', true, false", "'a', 's2', false, false", "'a', 's3', true, false", "'b', 's1', false, true", "'b', 's2', false, true"))
def payload_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = [("a", 1, "s1", True, 60), ("a", 2, "s2", False, 50), ("a", 3, "s3", False, 40), ("b", 1, "s1", True, 90), ("b", 2, "s2", True, 20)]
    return V.fill_payload(spark.createDataFrame(rows, "run string, ord int, source_id string, required boolean, size int"), 100)


@query(_values("run, mode, kept", "'big', 'retrieved_fragments', 2", "'small', 'full_catalog', 1"))
def catalogue_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("small", 0, 1, "s1", 50), ("big", 0, 1, "s1", 50), ("big", 0, 2, "s2", 30), ("big", 0, 3, "s3", 40)], "run string, batch int, ord int, source_id string, size int")
    kept = V.bounded_batches(rows, 90).groupBy("run").agg(F.count("*").cast("int").alias("kept"))
    return V.catalog_mode(rows, 100).join(kept, "run").select("run", "mode", "kept")


@query(_values("source_id, alias, document_id", "'x', 'B0001', 'D001'", "'y', 'A0001', 'D002'", "'z', 'B0002', 'D001'"))
def transport_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("r", "x", "before", "one", 1), ("r", "y", "after", "two", 2), ("r", "z", "before", "one", 3)]
    return V.transport_aliases(spark.createDataFrame(rows, "run string, source_id string, period string, document string, ord int")).drop("run")


@query(_values("k, error, n", "1, NULL, 1", "2, 'keys', NULL", "3, 'not_json', NULL", "4, 'not_json', NULL", "5, NULL, 0"))
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, '```json\n{"findings": [{"title": "x", "confidence": 0.5}]}\n```'), (2, '{"findings": [], "more": 1}'), (3, '{"findings": [{"title": "x", "confidence": NaN}]}'), (4, "no json"), (5, '{"findings": []}')]
    out = V.decoded(spark.createDataFrame(rows, "k int, answer string"), "answer", "findings array<struct<title: string, confidence: double>>", ("findings",))
    return out.select("k", "error", F.when(F.col("error").isNull(), F.size("value.findings")).alias("n"))


@query(_values("k, json, error", "1, '{\"k\":1,\"x\":0.5,\"t\":\"ё\"}', NULL", "2, NULL, 'not_finite'", "3, '{\"k\":3,\"x\":null,\"t\":\"\"}', NULL"))
def finite_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 0.5, "ё"), (2, float("nan"), "x"), (3, None, "")], "k int, x double, t string")
    return V.encoded(rows, ["k", "x", "t"]).select("k", "json", "error")


@query(_values("missing, extra, repeated, exact", "1, 1, 1, false"))
def exact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.exact_index(spark.createDataFrame([("a",), ("a",), ("x",)], "id string"), spark.createDataFrame([("a",), ("b",)], "id string"), "id")
    return rows.select(*(F.col(c).cast("int").alias(c) for c in ("missing", "extra", "repeated")), "exact")


@query(_values("source_id, related_id", "'s1', 's2'", "'s2', 's1'", "'s1', 'c1'", "'c1', 's1'", "'s2', 'c1'", "'c1', 's2'"))
def source_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.related_sources(spark.createDataFrame([(1, "s1", ["c1"]), (1, "s2", []), (2, "s9", [])], "row_ord int, frag_id string, contexts array<string>"))


@query(_values("source_id", "'f1'", "'f2'", "'f4'", "'f5'", "'c7'"))
def verification_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([("d", i, f"f{i}") for i in range(1, 9)], "document string, line_no int, frag_id string")
    members = spark.createDataFrame([(1, "f3", ["c7"]), (2, "f8", ["c8"])], "row_ord int, frag_id string, contexts array<string>")
    return V.verification_context(spark.createDataFrame([("f3",)], "source_id string"), lines, members)


@query(_values("attribution_id, reason", "'a', 'accepted'", "'b', 'wording'", "'c', 'numbers'", "'d', 'metrics'", "'e', 'unknown'", "'f', 'alternatives'"))
def draft_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    draft = lambda k, claim="показатель вырос на 5", ids=("m1",), other=("найм сотрудников",): (k, claim, "обмен данными", list(other), list(ids), ["c1"])
    rows = [draft("a"), draft("b", "реформа привела к росту"), draft("c", "вырос на 7"), draft("d", ids=("m2",)), draft("e"), draft("f", other=())]
    drafts = spark.createDataFrame(rows, "attribution_id string, claim string, mechanism string, alternatives array<string>, metric_ids array<string>, clause_ids array<string>")
    known = spark.createDataFrame([(k, "delta 5.0", ["m1"], ["c1"]) for k in "abcdf"], "attribution_id string, facts string, allowed_metrics array<string>, allowed_clauses array<string>")
    return V.check_drafts(drafts, known)


@query(_values("recommendation_id, n_risks", "'a', 2", "'b', 1", "'c', 1"))
def recommendation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = spark.createDataFrame([(k, "обсудить", ["сезон"], "delta 5") for k in "abc"], "recommendation_id string, action string, risks array<string>, facts string")
    said = spark.createDataFrame([("a", "проверить нагрузку", ["учтён ли найм"]), ("b", "нанять 3 человек", ["учтён ли найм"]), ("c", "проверить", ["рост 9"])], "recommendation_id string, action string, risks array<string>")
    return V.refined_recommendations(recs, said).select("recommendation_id", F.size("risks").alias("n_risks"))


@query(_values("event_id, reason", "'a', 'accepted'", "'b', 'quote'", "'c', 'codes'", "'d', 'unknown'", "'e', 'wording'"))
def mechanism_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    quote = "готовит ежемесячный отчет"
    row = lambda k, q=quote, codes=("audits_done",), m="срок отчета": (k, list(codes), m, q)
    rows = [row("a"), row("b", "нет такой цитаты"), row("c", codes=("nothing",)), row("d"), row("e", m="благодаря реформе")]
    events = spark.createDataFrame([(k, [f"Отдел {quote} об остатках"]) for k in "abce"], "event_id string, quotes array<string>")
    return V.check_mechanisms(spark.createDataFrame(rows, "event_id string, metric_codes array<string>, mechanism string, quote string"), events, tuple(m[0] for m in K.METRICS))


@query(_values("name, value", "'requests', 3::BIGINT", "'completed', 2", "'sent', 17", "'covered', 12", "'tokens_in', 300", "'tokens_out', 30", "'usage_unknown', 1"))
def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("r", "completed", 5, 100, 10), ("r", "completed", 7, 200, 20), ("r", "failed", 5, None, None)]
    return V.coverage_overview(spark.createDataFrame(rows, "run string, state string, sources long, tokens_in long, tokens_out long"))


@query(_values("id, reason", "'a', 'repeated_id'", "'b', 'source'", "'c', 'number'", "'d', 'scope_or_metric'", "'e', 'period'"))
def run_value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d1, d2 = date(2023, 1, 1), date(2023, 1, 31)
    row = lambda k, scope="s", a=d1, b=d2, x=1.0, quote="q": (k, "m", scope, a, b, x, "f", quote, "A1")
    rows = [row("ok"), row("a"), row("a"), row("b", quote=" "), row("c", x=float("inf")), row("d", scope=""), row("e", a=d2, b=d1)]
    return U.invalid_values(spark.createDataFrame(rows, "id string, metric string, scope string, start date, end date, value double, file string, quote string, cell string"))


@query(_values("event_id, reason", "'a', 'repeated_id'", "'b', 'date'", "'c', 'mechanism'"))
def run_event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = date(2023, 1, 1)
    rows = [("ok", d, "m", True, ["q"]), ("a", d, "m", False, []), ("a", d, "m", False, []), ("b", None, "", False, []), ("c", d, " ", True, ["q"])]
    return U.invalid_events(spark.createDataFrame(rows, "event_id string, effective date, mechanism string, confirmed boolean, quotes array<string>"))


@query(_values("n_synthetic, n_real, homogeneous", "1, 2, false"))
def namespace_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (spark.createDataFrame([(x,) for x in xs], "synthetic boolean") for xs in ((False, True), (False,)))
    return U.namespace_state(one, two).select(F.col("n_synthetic").cast("int").alias("n_synthetic"), F.col("n_real").cast("int").alias("n_real"), "homogeneous")


@query(_values("scope, granularity, n", "'x', 'month', 2", "'y', 'month', 1"))
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("m", "x", "month", "шт. "), ("m", "x", "month", "шт."), ("m", "x", "year", "шт."), ("m", "y", "month", "шт."), ("m", "z", "month", "дни"), ("k", "x", "month", "шт.")]
    return U.comparable_series(spark.createDataFrame(rows, "metric string, scope string, granularity string, unit string"), "m", "x").select("scope", "granularity", F.col("n").cast("int").alias("n"))


@query(_values("metric, allowed", "'audits_done', true", "'custom_1', true", "'custom_2', false"))
def uncatalogued_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("audits_done", False), ("custom_1", True), ("custom_1", True), ("custom_2", True), ("custom_2", False)]
    return U.allowed_metrics(spark.createDataFrame(rows, "metric string, confirmed boolean"), K.catalogue(spark))


@query(_values("place, warning", "1, 'synthetic data: effects are made, not measured'", "2, 'few points'", "3, 'trend'"))
def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.distinct_warnings(spark.createDataFrame([(1, "few points"), (2, "trend"), (3, "few points")], "ord long, warning string"), True)


@query(_values("recommendation_id, decision, error", "'a', 'accept', NULL", "'b', 'maybe', 'decision'", "'z', 'reject', 'recommendation'"))
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = spark.createDataFrame([("a",), ("b",)], "recommendation_id string")
    return U.save_decisions(recs, spark.createDataFrame([("a", "accept"), ("b", "maybe"), ("z", "reject")], "recommendation_id string, decision string"))


@query(_values("event_id, mechanism, confirmed", "'n1', 'срок', true", "'n2', '', false"))
def mechanism_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "namespace string, event_id string, type string, units array<string>, quotes array<string>, mechanism string, metric_codes array<string>, confirmed boolean"
    old = spark.createDataFrame([("real", "e1", "t", ["b", "a"], ["q1"], "срок", ["m"], True), ("real", "e2", "t", ["a"], ["q2"], "x", ["m"], False)], schema)
    empty = spark.createDataFrame([("real", U.STAGES[0], "gone", ["m"])], "namespace string, mechanism_key string, mechanism string, metric_codes array<string>")
    new = spark.createDataFrame([("real", "n1", "t", ["a", "b"], ["q1"], "", [], False), ("real", "n2", "t", ["a"], ["q2"], "", [], False)], schema)
    return U.apply_mechanisms(new, U.cache_mechanisms(empty, old)).select("event_id", "mechanism", "confirmed")


@query(_values("event_id, reason", "'a', 'accepted'", "'b', 'date'", "'c', 'codes'", "'d', 'mechanism'", "'e', 'quotes'"))
def event_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = date(2023, 1, 1)
    rows = [("a", True, d, ["audits_done"], "m", True, ["q"]), ("b", False, d, [], "", False, []), ("c", True, d, ["nothing"], "", False, []), ("d", True, d, ["audits_done"], "", True, ["q"]), ("e", True, d, ["audits_done"], "m", True, [])]
    return U.event_edit_errors(spark.createDataFrame(rows, "event_id string, date_confirmed boolean, effective date, metric_codes array<string>, mechanism string, confirmed boolean, quotes array<string>"), tuple(m[0] for m in K.METRICS))


@query(_values("hypothesis_id, reason", "1, 'accepted'", "2, 'prediction'", "3, 'event'", "4, 'direction'", "5, 'horizon'"))
def manual_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, later = date(2023, 1, 1), date(2023, 6, 30)
    rows = [(1, "e", "рост", "up", later), (2, "e", " ", "up", later), (3, "z", "рост", "up", later), (4, "e", "рост", "more", later), (5, "e", "рост", "up", d)]
    return U.hypothesis_errors(spark.createDataFrame(rows, "hypothesis_id int, event_id string, prediction string, direction string, horizon date"), spark.createDataFrame([("e", d)], "event_id string, effective date"))


@query(_values("unit, label", "'Департамент операционного аудита', 'ДОА'", "'Отдел', 'Отдел'", "'Управление складов', 'П3'", "'ДОА', 'П4'"))
def unit_label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Департамент операционного аудита"), (2, "Отдел"), (3, "Управление складов"), (4, "ДОА")]
    return R.unit_labels(spark.createDataFrame(rows, "ord int, unit string"))


@query(_values("line", "'Положение (редакция № 2, дата 01.02.2023)'", "'Приказ'"))
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("before", 1, "Положение", "2", "", "01.02.2023"), ("after", 1, "Приказ", None, None, None)]
    return R.document_lines(spark.createDataFrame(rows, "period string, ord int, name string, edition string, protocol string, date string")).select("line")


@query(_values("key, column_name, part, parts, size, first", "'1', 'a', 1, 2, 15000, 'x'", "'1', 'a', 2, 2, 5, 'x'", "'1', 'b', 1, 1, 7, ''''"))
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.sheet(spark.createDataFrame([(1, "x" * 15_005, "=1+1+1")], "k int, a string, b string"), "S", "k", ["a", "b"])
    return rows.select("key", F.col("column").alias("column_name"), "part", "parts", F.length("value").alias("size"), F.substring("value", 1, 1).alias("first"))


@query(_values("finding_no, kind, line", "1, 0, '### a\\*b'", "1, 1, '- п. 1: &lt;b&gt;'", "1, 1, '- ?: source not found'"))
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.createDataFrame([(1, "a*b", ["s1", "s9"])], "finding_no int, title string, sources array<string>")
    return R.markdown(found, spark.createDataFrame([("s1", "п. 1", "<b>")], "source_id string, locator string, text string")).drop("source_id")


@query(_values("text", "'matched 3, lost 1, new 2, duplicates 1, conflicts 0; all need review'"))
def report_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("row_preserved", 1), ("row_moved", 2), ("row_lost", 1), ("row_new", 2), ("finding_duplicate", 1)]
    return R.conclusion(spark.createDataFrame(rows, "name string, value long"))


@query(_values("place, line", "1, 'SYNTHETIC DATA · values (r1)'", "2, 'SYNTHETIC DATA · a / b'", "3, 'SYNTHETIC DATA · events (r1)'"))
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, none = spark.createDataFrame([("a\nb",)], "t string"), spark.createDataFrame([], "t string")
    return U.report_lines("r1", True, [("values", one, F.col("t")), ("events", none, F.col("t"))])


@query(_values("kind, shown, hidden", "'loss', 1, 1", "'conflict', 1, 0"))
def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("loss", 0.5), ("loss", 0.3), ("conflict", 0.4), ("duplicate", 0.9)], "kind string, score double")
    shown, hidden = R.filter_findings(rows, ("loss", "conflict"))
    return shown.groupBy("kind").agg(F.count("*").cast("int").alias("shown")).join(hidden, "kind", "left").select("kind", "shown", F.coalesce("hidden", F.lit(0)).cast("int").alias("hidden"))


@query(_values("name, value", "'loss', 2::BIGINT", "'duplicate', 0", "'conflict', 1", "'strong', 1"))
def overview_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.executive_overview(spark.createDataFrame([("loss", 0.8), ("loss", 0.2), ("conflict", 0.5)], "kind string, score double"))


@query(_values("k, start, granularity", "1, '2023-01-01', 'quarter'", "2, NULL, NULL", "3, '2022-01-01', 'year'"))
def dated_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "2023-01-01/2023-03-31"), (2, "2023-01-01/2023-03-31/year"), (3, "2022")]
    p = spark.createDataFrame(rows, "k int, text string").select("k", I.dated_period(F.col("text")).alias("p"))
    return p.select("k", F.col("p.start").cast("string").alias("start"), "p.granularity")


@query(_values("k, text", "1, 'the limit of requests is reached'", "2, 'the service failed'", "3, 'the step did not finish; local results are kept'"))
def safe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(1, "429"), (2, "503"), (3, "key sk-1")], "k int, status string").select("k", V.safe_error(F.col("status")).alias("text"))


def _pages(spark: SparkSession) -> DataFrame:
    broken = "\n".join(["слово"] * 21)
    rows = [("a", 1, "1. Общее\nтекст\n\n1.1. Первое;\nа. второе", None), ("a", 2, " \n", None), ("b", 1, broken, "слово за словом"), ("b", 2, broken, "")]
    return spark.createDataFrame(rows, "document string, page_no int, text string, layout string")


@query(_values("document, locator, text", "'a', 'page 1, block 1', '1. Общее текст'", "'a', 'page 1, block 2', '1.1. Первое;'", "'a', 'page 1, block 3', 'а. второе'", "'b', 'page 1, block 1', 'слово за словом'", f"'b', 'page 2, block 1', '{' '.join(['слово'] * 21)}'"))
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_blocks(_pages(spark)).select("document", "locator", "text")


@query(_values("document, n_empty, named", "'a', 1::BIGINT, '2'"))
def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_warnings(_pages(spark))


@query(_values("file, by_content, by_name", "'SYNTH_b.xlsx', false, true", "'c.xlsx', true, false"))
def synthetic_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("SYNTH_a.xlsx", 1, 1, "ТЕСТОВЫЕ ДАННЫЕ"), ("SYNTH_b.xlsx", 1, 1, "x"), ("c.xlsx", 1, 1, "is_synthetic"), ("c.xlsx", 1, 2, "1"), ("d.xlsx", 1, 1, "is_synthetic"), ("d.xlsx", 2, 1, "1")]
    return O.marker_errors(spark.createDataFrame([(f, "S", 1, r, c, raw) for f, r, c, raw in rows], "file string, sheet string, table_no int, r int, c int, raw string"))


@query(_values("sheet, r, c, raw", "'Findings', 1, 1, 'title'", "'Findings', 2, 1, '''=1+1'", "'Findings', 2, 2, 'a < b & c'", "'Units', 1, 28, 'last'"))
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's cells written as a workbook and read back from its bytes."""
    ship(spark)
    rows = [("r.xlsx", 1, "Findings", 2, 2, "a < b & c"), ("r.xlsx", 2, "Units", 1, 28, "last"), ("r.xlsx", 1, "Findings", 1, 1, "title"), ("r.xlsx", 1, "Findings", 2, 1, "'=1+1")]
    made = O.workbooks(spark.createDataFrame(rows, "file string, sheet_no int, sheet string, r int, c int, value string"))
    return O.cells_of(made.select(F.col("file").alias("path"), "content")).select("sheet", "r", "c", "raw")
