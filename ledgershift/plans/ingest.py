"""Queries over report cells that are made from orders: workbooks of market segments in the three layouts that reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import periods as P
from ..operators import catalog as K
from ..operators import ingest as I
from .base import query, table

# Short month names as the reports of these queries write them.
MONTHS = ("янв", "фев", "мар", "апр", "май", "июн", "июл", "авг", "сен", "окт", "ноя", "дек")

_COUNTS = """c AS (SELECT c_mktsegment AS seg, date_trunc('month', o_orderdate)::DATE AS m, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
    k AS (SELECT *, (dense_rank() OVER (ORDER BY seg) - 1) % 3 AS layout FROM c)"""


def _month(day: Column) -> Column:
    return F.concat(F.element_at(F.array(*(F.lit(x) for x in MONTHS)), F.month(day)), F.lit(" "), F.year(day).cast("string"))


def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a workbook a segment: orders by month as a long table, a wide one (months as columns) or a transposed one (metrics as columns), by turns."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.groupBy(F.col("c_mktsegment").alias("seg"), F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").alias("n"))
    segs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg")).distinct()
    turn = segs.agg(F.array_sort(F.collect_set("seg")).alias("all"))  # one row: the market segments
    rows = rows.join(F.broadcast(turn)).withColumn("layout", (F.array_position("all", F.col("seg")) - 1) % 3).drop("all")
    day, n = F.col("m"), F.col("n").cast("string")
    at = (F.year(day) * 12 + F.month(day) - 1980 * 12).cast("int")
    cell = lambda r, c, raw, num=None: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), raw.alias("raw"), (F.lit(None).cast("double") if num is None else num).alias("num"))
    lit = F.lit
    long = F.array(
        cell(lit(1), lit(1), lit("Показатель")), cell(lit(1), lit(2), lit("Значение")), cell(lit(1), lit(3), lit("Период")), cell(lit(1), lit(4), lit("Подразделение")), cell(lit(1), lit(5), lit("Единица измерения")),
        cell(at * 2, lit(1), lit("Проведено проверок, шт.")), cell(at * 2, lit(2), F.concat(n, lit(" шт."))), cell(at * 2, lit(3), _month(day)), cell(at * 2, lit(4), F.col("seg")), cell(at * 2, lit(5), lit("ед.")),
        cell(at * 2 + 1, lit(1), lit("Количество проверок")), cell(at * 2 + 1, lit(2), n), cell(at * 2 + 1, lit(3), F.date_format(day, "yyyy-MM")), cell(at * 2 + 1, lit(4), F.col("seg")), cell(at * 2 + 1, lit(5), lit("шт.")),
    )
    wide = F.array(cell(lit(1), at, F.date_format(day, "yyyy/MM")), cell(lit(2), lit(1), lit("audits_done")), cell(lit(2), at, n, F.col("n").cast("double")))
    turned = F.array(cell(lit(1), lit(2), lit("Проведено аудитов")), cell(lit(1), lit(3), lit("Выявлено нарушений (шт.)")), cell(at, lit(1), _month(day)), cell(at, lit(2), n), cell(at, lit(3), F.concat(n, lit(" дней"))))
    made = rows.select("seg", F.explode(F.when(F.col("layout") == 0, long).when(F.col("layout") == 1, wide).otherwise(turned)).alias("x")).distinct()
    return made.select(F.concat("seg", F.lit(".xlsx")).alias("file"), F.col("seg").alias("sheet"), F.lit(1).alias("table_no"), "x.r", "x.c", "x.raw", "x.num", F.lit("General").alias("fmt"))


@query(f"WITH {_COUNTS} SELECT seg AS scope, 'audits_done' AS code, m::VARCHAR AS start, last_day(m)::VARCHAR AS \"end\", n::DOUBLE AS value, 'шт.' AS unit FROM k")
def kpi_report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that every rule lets through: metrics by their other names, periods as names and numbers, texts and numeric cells."""
    known = K.catalogue(spark)
    values, _ = I.accept(I.records(report_cells(spark, sf_dir), known), known)
    return values.select("scope", "code", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "value", "unit")


@query(f"""WITH {_COUNTS} SELECT seg AS scope, 'Количество проверок' AS label, 'ambiguous_metric' AS reason, m::VARCHAR AS start, n::DOUBLE AS value FROM k WHERE layout = 0
    UNION ALL SELECT seg, 'Выявлено нарушений (шт.)', 'unit_mismatch', m::VARCHAR, n FROM k WHERE layout = 2""")
def kpi_report_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that wait for a human: a name of two metrics, and days where pieces are due."""
    known = K.catalogue(spark)
    _, queue = I.accept(I.records(report_cells(spark, sf_dir), known), known)
    return queue.select("scope", "label", "reason", F.col("start").cast("string").alias("start"), "value")


_FORMS = """t AS (SELECT o_orderkey, o_orderkey % 12 AS k, o_orderdate::DATE AS d FROM orders)"""


@query(f"""WITH {_FORMS} SELECT o_orderkey, CASE WHEN k IN (0, 1, 2) THEN 'quarter' WHEN k IN (3, 4, 5, 6) THEN 'month' WHEN k IN (7, 8) THEN 'year' END AS granularity,
    CASE WHEN k IN (0, 1, 2) THEN date_trunc('quarter', d) WHEN k IN (3, 4, 5, 6) THEN date_trunc('month', d) WHEN k IN (7, 8) THEN date_trunc('year', d) END::DATE::VARCHAR AS start FROM t""")
def period_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve ways to write the date of an order; the last three name no reporting period."""
    d, year = F.col("o_orderdate"), F.year("o_orderdate").cast("string")
    q, said = F.quarter(d).cast("string"), _month(d)
    forms = [
        F.concat(q, F.lit(" квартал "), year), F.concat(year, F.lit(" q"), q), F.concat(q, F.lit(" quarter, "), year), said, F.date_format(d, "yyyy.M"), F.date_format(d, "yyyy/MM"), F.concat(F.regexp_extract(said, r"^\S+", 0), F.lit("."), F.concat(F.lit(""), year)),
        F.concat(F.lit("Отчёт за "), year, F.lit(" год")), F.concat(F.lit("период "), year), F.concat(F.lit("marble "), F.substring(year, 3, 2)), F.concat(F.lit("Q"), q, F.lit(" "), year, F.lit(" редакция")), F.date_format(d, "dd.MM.yyyy"),
    ]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", P.parse_period(F.get(F.array(*forms), (F.col("o_orderkey") % 12).cast("int"))).alias("p"))
    return rows.select("o_orderkey", "p.granularity", F.col("p.start").cast("string").alias("start"))
