"""Queries of what a reviewer sees and decides: confirmations, display tables, charts, sources in order, limits of answers, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as Me
from ..operators import catalog as K
from ..operators import explore as X
from ..operators import ingest as I
from ..operators import registry as G
from ..operators import reports as R
from ..operators import review as V
from ..operators import runs as U
from .base import query, table

_QUEUED = """q AS (SELECT o_orderkey AS k, o_custkey AS cust, date_trunc('year', o_orderdate)::DATE AS y, o_orderdate::DATE AS d, o_orderstatus, o_orderkey * 7919 % 900000 + 1000 AS v, o_custkey % 2 = 0 AS clash FROM orders),
    t AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'unknown_item' WHEN k % 6 = 4 THEN 'number' WHEN k % 13 = 0 OR o_orderstatus = 'P' THEN 'scope_or_period' WHEN k % 7 = 0 THEN 'metric' WHEN k % 7 = 1 AND k % 2 = 0 THEN 'custom_metric' END AS broken,
      CASE k % 7 WHEN 0 THEN 'nothing' WHEN 1 THEN 'custom_' || k ELSE 'audits_done' END AS code FROM q WHERE k % 3 <> 2),
    f AS (SELECT *, min(k) FILTER (broken IS NULL) OVER (PARTITION BY CASE WHEN k % 11 = 0 THEN 'none' WHEN clash THEN cust || ' ' || y || CASE k % 7 WHEN 1 THEN ' c' || k ELSE '' END ELSE 'id' || k END) AS first FROM t)"""


def _confirmed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as queued numbers in six ways to write them (one of them another number), and what was decided on two thirds of them."""
    k, number = F.col("o_orderkey"), F.col("o_orderkey") * 7919 % 900_000 + 1000
    rows = table(spark, sf_dir, "orders").withColumn("v", number)
    grouped = lambda sign: F.regexp_replace(F.col("v").cast("string"), r"(\d{3})$", f"{sign}$1")
    quotes = [grouped(","), grouped(" "), grouped("."), F.col("v").cast("string"), (F.col("v") + 1).cast("string"), F.concat(F.lit("2 из "), F.col("v").cast("string"))]
    quote = F.concat(F.lit("Всего "), F.get(F.array(*quotes), (k % 6).cast("int")), F.lit(" шт."))
    year, custom = F.trunc("o_orderdate", "year"), F.concat(F.lit("custom_"), k.cast("string"))
    code = F.when(k % 7 == 1, custom).otherwise("audits_done")
    queue = rows.select(k.cast("string").alias("id"), code.alias("code"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("scope"), year.alias("start"), F.last_day(F.add_months(year, 11)).alias("end"), F.col("v").cast("double").alias("value"), quote.alias("quote"), F.lit("Проверки").alias("label"), F.when(F.col("o_custkey") % 2 == 0, "conflict").otherwise("number").alias("reason"))
    month, ident = F.trunc("o_orderdate", "month"), F.when(k % 11 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))
    end = F.when(F.col("o_orderstatus") == "P", month).otherwise(F.last_day(month))
    said = rows.where(k % 3 != 2).select(k.alias("ord"), ident.alias("id"), F.when(k % 7 == 0, "nothing").otherwise(code).alias("code"), F.when(k % 13 == 0, " ").otherwise("DNM").alias("scope"), month.alias("start"), end.alias("end"), F.lit("month").alias("granularity"), F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("v")).cast("double").alias("value"), F.when(k % 2 == 1, "шт.").alias("unit"))
    return queue, I.confirmations(queue, said, K.catalogue(spark))


@query(f"""WITH {_QUEUED} SELECT k AS ord, CASE WHEN k % 11 <> 0 AND k > first THEN 'resolved' ELSE coalesce(broken, 'confirmed') END AS state, code, CASE WHEN k % 13 = 0 THEN '' ELSE 'ДНМ' END AS scope,
    CASE WHEN k % 11 <> 0 OR k % 5 <> 0 THEN v::DOUBLE END AS value, CASE WHEN k % 2 = 1 OR code = 'audits_done' THEN 'шт.' END AS unit FROM f""")
def kpi_confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a human decided on queued numbers: confirmed if the number stands in the quote, grouped or not, and scope, period and metric are whole."""
    return _confirmed(spark, sf_dir)[1].select("ord", "state", "code", "scope", "value", "unit")


@query(f"""WITH {_QUEUED}, c AS (SELECT * FROM f WHERE broken IS NULL AND k = first) SELECT k::VARCHAR AS id, CASE WHEN clash THEN 'conflict' ELSE 'number' END AS reason FROM q WHERE k NOT IN (SELECT k FROM c)
    AND NOT (clash AND EXISTS (SELECT 1 FROM c WHERE c.clash AND c.cust = q.cust AND c.y = q.y AND c.k % 7 <> 1 AND q.k % 7 <> 1))""")
def kpi_still_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still waits after the decisions: a confirmed conflict takes the other values of its key along."""
    queue, said = _confirmed(spark, sf_dir)
    return I.still_queued(queue, said.where("state = 'confirmed'")).select("id", "reason")


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'SYNTHETIC DATA' ELSE 'REPORT DATA' END AS data, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Проверок проведено' WHEN 1 THEN 'Штатная численность' ELSE 'own' END AS metric_name, o_totalprice AS value,
    'orders.xlsx' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' · ' || o_orderstatus END || ' · B' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN ' · p. ' || (o_orderkey % 7) ELSE '' END AS source, o_orderkey % 4 = 0 AS confirmed FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0
    UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'SYNTHETIC DATA' ELSE 'REPORT DATA' END, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Проверок проведено' WHEN 1 THEN 'Штатная численность' ELSE 'own' END, o_totalprice,
    'orders.xlsx' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' · ' || o_orderstatus END || ' · B' || o_custkey, o_orderkey % 4 = 0 FROM orders WHERE o_orderkey % 35 = 0""")
def kpi_value_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the table of values: metrics by name, sources joined from what is given; a page 0 is none."""
    k = F.col("o_orderkey")
    metric = F.when(k % 3 == 0, "audits_done").when(k % 3 == 1, "headcount").otherwise("own")
    values = table(spark, sf_dir, "orders").select(
        k.alias("id"), metric.alias("metric"), F.col("o_totalprice").alias("value"), F.lit("шт.").alias("unit"), F.lit("s").alias("scope"), F.to_date("o_orderdate").alias("start"), F.to_date("o_orderdate").alias("end"), (k % 2 == 0).alias("synthetic"),
        F.when(k % 4 == 0, True).alias("confirmed"), F.lit("orders.xlsx").alias("file"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("sheet"), F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("cell"),
        F.when(k % 5 == 0, k % 7).alias("page"), F.lit(None).cast("string").alias("locator"),
    )
    known = spark.createDataFrame([m[:2] for m in K.METRICS], "code string, name string")
    return R.value_rows(values, known).select("data", "id", "metric_name", "value", "source", "confirmed")


_SHOWN = """v AS (SELECT event_type AS metric, 'u' || user_id % 7 AS scope, user_id, CASE WHEN value < 20 THEN 'month' WHEN value < 60 THEN 'quarter' ELSE 'year' END AS granularity, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'дни' ELSE 'шт.' END AS unit, ts::DATE AS start, value FROM events),
    g AS (SELECT granularity FROM v WHERE metric = 'error' GROUP BY granularity ORDER BY count(*) DESC, CASE granularity WHEN 'month' THEN 0 WHEN 'quarter' THEN 1 ELSE 2 END LIMIT 1),
    u AS (SELECT unit FROM v JOIN g USING (granularity) WHERE metric = 'error' GROUP BY unit ORDER BY count(*) DESC, unit LIMIT 1)"""


@query(f"WITH {_SHOWN} SELECT scope, CASE WHEN scope IN ('u0', 'u3') THEN 'control' ELSE 'observed' END AS role, granularity, unit, count(*) AS n, round(sum(value::DECIMAL(18, 4)), 4)::DOUBLE AS total FROM v JOIN g USING (granularity) JOIN u USING (unit) WHERE metric = 'error' GROUP BY ALL")
def kpi_default_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart that opens over all events, the errors having been compared first: its most frequent granularity, then unit; scopes with their role."""
    value = F.col("value")
    unit = F.get(F.array(F.lit(None), F.lit("дни"), F.lit(" шт.")), (F.col("event_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("scope"), F.when(value < 20, "month").when(value < 60, "quarter").otherwise("year").alias("granularity"), unit.alias("unit"), F.to_date("ts").alias("start"), "value")
    chart = U.default_chart(rows, "error")
    shown = U.chart_rows(rows, chart, rows.where("scope IN ('u0', 'u3')").select("scope")).crossJoin(F.broadcast(chart))  # one row
    return shown.groupBy("scope", "role", "granularity", "unit").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 4).cast("double").alias("total"))


_LINE = "l_orderkey * 8 + l_linenumber AS ord"


@query(f"""WITH p AS (SELECT 'p' || l_partkey AS fn_id, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS producer, {_LINE} FROM lineitem UNION ALL SELECT 's' || l_suppkey, 2, {_LINE.replace(' AS ord', '')} FROM lineitem),
    f AS (SELECT fn_id, min({{'p': producer, 'o': ord}}) AS seen FROM p GROUP BY fn_id) SELECT fn_id, row_number() OVER (ORDER BY seen, fn_id) AS place FROM f""")
def first_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments in the order in which they are first met: those of rows before, of rows after, then of matches alone."""
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    part = rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("fn_id"), "ord", "l_linestatus")
    matched = rows.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("fn_id"), "ord")
    return X.first_seen([part.where("l_linestatus = 'F'"), part.where("l_linestatus <> 'F'"), matched], "fn_id")


@query("""WITH l AS (SELECT 'p' || l_partkey AS source_id, 'o' || l_orderkey AS text, l_orderkey AS ord, CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity < 30 THEN 3 WHEN l_quantity < 40 THEN 4 ELSE 5 END AS producer FROM lineitem WHERE l_returnflag <> 'R'),
    a AS (SELECT 'p' || p_partkey AS source_id, 0 AS producer, p_partkey AS ord, p_name AS text FROM part WHERE p_size < 25 UNION ALL SELECT source_id, producer, ord, text FROM l),
    f AS (SELECT source_id, min({'p': producer, 'o': ord}) AS seen, max({'p': producer, 'o': ord, 't': text}) AS last FROM a GROUP BY source_id)
    SELECT source_id, row_number() OVER (ORDER BY seen, source_id) AS place, last.t AS text FROM f""")
def source_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of sources from six producers (listed, unit changes, findings, evidence, functions, contexts): first place, last text."""
    part = table(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("text"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_id"), F.col("l_orderkey").alias("ord"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("text"), "l_quantity")
    within = [lines.where((F.col("l_quantity") >= low) & (F.col("l_quantity") < high)).drop("l_quantity") for low, high in ((0, 10), (10, 20), (20, 30), (30, 40), (40, 1_000_000))]
    return X.collected_sources([part, *within], "source_id", "text")


@query("""WITH i AS (SELECT l_suppkey AS run, CASE l_returnflag WHEN 'R' THEN 'comparison' WHEN 'A' THEN 'risk' ELSE CASE l_linenumber WHEN 1 THEN 'other' ELSE 'attribution' END END AS kind, l_partkey % 97 AS signature, l_orderkey * 8 + l_linenumber AS ord FROM lineitem),
    d AS (SELECT run, kind, signature, min(ord) AS ord, count(*) AS n FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY run, kind ORDER BY ord) AS place FROM d),
    s AS (SELECT run, CASE WHEN kind = 'other' THEN 'unknown_kind' WHEN place > CASE kind WHEN 'comparison' THEN 30 WHEN 'risk' THEN 15 ELSE 8 END THEN 'over_limit' ELSE 'taken' END AS state, kind, 1 AS n FROM r
      UNION ALL SELECT run, CASE WHEN kind = 'other' THEN 'unknown_kind' ELSE 'repeated' END, kind, n - 1 FROM d)
    SELECT run, kind, state, sum(n)::BIGINT AS n FROM s GROUP BY ALL HAVING sum(n) > 0""")
def answer_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items of answers, a supplier a request: what each kind's limit lets in, repeated ones not counting."""
    line = F.col("l_linenumber")
    kind = F.when(F.col("l_returnflag") == "R", "comparison").when(F.col("l_returnflag") == "A", "risk").when(line == 1, "other").otherwise("attribution")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("run"), kind.alias("kind"), (F.col("l_partkey") % 97).alias("signature"), (F.col("l_orderkey") * 8 + line).alias("ord")).agg(F.count("*").alias("copies"))
    rows = rows.select("run", "kind", "signature", "ord", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one"))
    return V.within_answer(rows).groupBy("run", "kind", "state").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN bad AND l_returnflag <> 'N' AND l_linestatus = 'F' THEN 'restore_requirement' WHEN bad AND l_returnflag <> 'N' THEN 'discuss_capacity' END AS action, (round(l_discount * 100)::BIGINT) || '%' AS shown
    FROM (SELECT *, (l_partkey % 3 = 0 AND l_quantity < 25) OR (l_partkey % 3 = 1 AND l_quantity > 25) AS bad FROM lineitem)""")
def comparison_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as compared metrics: what an adverse change asks for, and its share as it is shown."""
    way = F.col("l_partkey") % 3
    rows = table(spark, sf_dir, "lineitem").withColumns({"better": F.when(way == 0, "up").when(way == 1, "down").otherwise("context"), "delta_abs": F.col("l_quantity") - 25, "level": F.when(F.col("l_returnflag") == "N", "low").when(F.col("l_returnflag") == "A", "medium").otherwise("high"), "event_type": F.when(F.col("l_linestatus") == "F", "func_lost").otherwise("func_moved")})
    return U.comparison_actions(rows).select("l_orderkey", "l_linenumber", "l_partkey", "action", Me.shown_metric(F.lit("text_similarity"), F.col("l_discount").cast("string")).alias("shown"))


@query("SELECT o_orderkey AS attribution_id, l_partkey AS id, p_name AS name FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def evidence_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts that each order's list of ids names."""
    named = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("attribution_id")).agg(F.collect_set("l_partkey").alias("metric_ids"))
    named = named.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("attribution_id")), "attribution_id", "left_semi")
    return U.drill_down(named, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))).select("attribution_id", "id", "name")


@query("""WITH d AS (SELECT l_orderkey, CASE max(l_linenumber) % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'discuss' END AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT o_orderkey AS recommendation_id, coalesce(d, 'discuss') AS decision FROM orders LEFT JOIN d ON l_orderkey = o_orderkey""")
def restored_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the decision stored for them, under discussion where there is none."""
    said = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("recommendation_id")).agg((F.max("l_linenumber") % 3).alias("k"))
    stored = said.select("recommendation_id", F.when(F.col("k") == 0, "accept").when(F.col("k") == 1, "reject").otherwise("discuss").alias("decision"))
    return G.restore_decisions(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("recommendation_id")), stored)


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND contains(lower(concat_ws(' ', doc_id::VARCHAR, source, 'line', text)), 'the')")
def found_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents that hold a word in id, document, place or text, whatever the case."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("source_id"), F.col("lang").alias("period"), F.col("source").alias("document"), F.lit("line").alias("locator"), "text")
    return R.search_sources(rows, "The", "en").select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size % 3 = 1 AND (contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1'))")
def matrix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as matrix rows: of two kinds, one status, with a word in label or owners."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_brand").alias("owners_before"), F.lit("").alias("owners_after"), F.col("p_type").alias("norm_type"), (F.col("p_size") % 3).cast("string").alias("status"))
    return R.filter_matrix(rows, ("ECONOMY", "PROMO"), ("1",), "BRAND#1").select("p_partkey")


@query("SELECT p_partkey AS source_id, CASE WHEN p_size < 25 THEN 'left' ELSE 'right' END AS period FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def uncovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large order line has held."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") < 25, "left").otherwise("right").alias("period"))
    return V.uncovered(parts, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("source_id")))


@query("""SELECT o_custkey, 'R' || row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) AS number, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 8""")
def short_report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight orders of each customer, as a short report lists them, numbered through."""
    rows = R.first_items(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"], R.FIRST_MOVED)
    return R.numbered(rows, "R", ["o_custkey", "o_orderdate", "o_orderkey"]).select("o_custkey", "number", "o_orderkey")
