"""Queries on KPI series: orders and customers stand for reported values, market segments for units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import close
from ..operators import compare as C
from ..operators import registry as R
from ..operators import series as S
from .base import query, table

EFFECTIVE, SEGMENTS = "1998-06-15", ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

_M = """m AS (SELECT c_mktsegment AS scope, date_trunc('month', o_orderdate)::DATE AS s, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS e,
  count(*)::DOUBLE AS value, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderdate < TIMESTAMP '2001-08-01' GROUP BY ALL)"""
_MID = "((date_diff('day', DATE '0001-01-01', s) + 1) + (date_diff('day', DATE '0001-01-01', e) + 1)) / 2.0"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.monthly_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.as_points(_monthly(spark, sf_dir), ("orders_count",))


def _event(spark: SparkSession, event_id: str, effective: str, units: tuple[str, ...], codes: tuple[str, ...] = ("orders_count",)) -> DataFrame:
    arrays = [F.array(*(F.lit(x) for x in xs)).cast("array<string>") for xs in (units, codes)]
    return spark.range(1).select(F.lit(event_id).alias("event_id"), F.to_date(F.lit(effective)).alias("effective"), arrays[0].alias("units"), arrays[1].alias("metric_codes"))


@query(f"WITH {_M} SELECT scope, s AS period_start, e AS period_end, value AS orders_count, revenue FROM m", ("period_start", "period_end"))
def kpi_monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).withColumnsRenamed({"start": "period_start", "end": "period_end"})


def _rollup_sql(unit: str, months: int, value: str, source: str = "value") -> str:
    return f"""WITH {_M}, g AS (SELECT scope, date_trunc('{unit}', s)::DATE AS period_start, (date_trunc('{unit}', s) + INTERVAL {months} MONTH - INTERVAL 1 DAY)::DATE AS period_end,
      {value.format(source)} AS v, count(*) AS n, min(s) AS lo, max(e) AS hi FROM m GROUP BY ALL)
    SELECT scope, period_start, period_end, n AS n_points, CASE WHEN n = {months} THEN round(v, 6) END AS value,
      CASE WHEN n = {months} THEN NULL WHEN date_diff('month', lo, hi) + 1 > n THEN 'gap' ELSE 'incomplete' END AS reason FROM g"""


def _rolled(spark: SparkSession, sf_dir: str, unit: str, aggregation: str, metric: str = "orders_count") -> DataFrame:
    points = S.as_points(_monthly(spark, sf_dir), (metric,))
    out = S.rollup(points, unit, aggregation)
    return out.select("scope", F.col("start").alias("period_start"), F.col("end").alias("period_end"), "n_points", F.round("value", 6).alias("value"), "reason")


@query(_rollup_sql("quarter", 3, "sum({})"), ("period_start", "period_end"))
def kpi_rollup_quarter_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir, "quarter", "sum")


@query(_rollup_sql("year", 12, "avg({})"), ("period_start", "period_end"))
def kpi_rollup_year_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir, "year", "mean")


@query(_rollup_sql("year", 12, "max_by({}, s)", "revenue"), ("period_start", "period_end"))
def kpi_rollup_year_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir, "year", "last", "revenue")


@query(
    f"""WITH {_M}, q AS (SELECT c_mktsegment AS scope, date_trunc('quarter', o_orderdate)::DATE AS period_start, count(*)::DOUBLE AS native FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    n AS (SELECT scope, date_trunc('quarter', s)::DATE AS period_start, CASE WHEN count(*) = 3 THEN sum(value) END AS nested FROM m GROUP BY ALL)
    SELECT scope, period_start, native, nested, coalesce(abs(native - nested) <= 1e-9 * greatest(native, nested, 1), false) AS agrees FROM q LEFT JOIN n USING (scope, period_start)""",
    ("period_start",),
)
def kpi_native_vs_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    native = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy(F.col("c_mktsegment").alias("scope"), F.trunc("o_orderdate", "quarter").alias("start")).agg(F.count("*").cast("double").alias("value"))
    native = native.select(F.lit("orders_count").alias("metric"), "scope", "start", F.last_day(F.add_months("start", 2)).alias("end"), "value")
    return S.reconcile(native, S.rollup(_counts(spark, sf_dir), "quarter", "sum")).select("scope", F.col("start").alias("period_start"), "native", "nested", F.coalesce("agrees", F.lit(False)).alias("agrees"))


def _compare_sql(where: str, method: str, adjusted: str, control: str = "NULL", extra: str = "", join: str = "") -> str:
    d = f"DATE '{EFFECTIVE}'"
    return f"""WITH {_M}, p AS (SELECT m.*, {_MID} AS mid, e < {d} AS b, s > {d} AS a FROM m WHERE {where}){extra},
    g AS (SELECT p.scope, count(*) FILTER (b) AS n_before, count(*) FILTER (a) AS n_after, count(*) FILTER (NOT a AND NOT b) AS n_excluded,
      avg(value) FILTER (b) AS mb, avg(value) FILTER (a) AS ma, coalesce(regr_slope(value, mid) FILTER (b), 0) AS k, avg(mid) FILTER (b) AS xb, avg(mid) FILTER (a) AS xa,
      min(mid) FILTER (a) AS x0, max(mid) FILTER (a) AS x1 {', bool_and(c IS NOT NULL OR (NOT a AND NOT b)) AS covered, avg(c) FILTER (b) AS cb, avg(c) FILTER (a) AS ca' if join else ''}
      FROM p {join} GROUP BY p.scope),
    t AS (SELECT *, {method} AS method FROM g)
    SELECT 'E1' AS event_id, 'orders_count' AS metric, scope, n_before, n_after, n_excluded, round(mb, 6) AS mean_before, round(ma, 6) AS mean_after, round(ma - mb, 6) AS delta_abs,
      round((ma - mb) / abs(mb) * 100, 6) AS delta_pct, method, {control} AS control_scope, round({adjusted}, 6) AS adjusted_delta, abs(ma - mb) > greatest(0.05 * abs(mb), 1e-9) AS descriptive_change FROM t"""


_TREND = "CASE WHEN n_before >= 3 AND least(mb + k * (x0 - xb), mb + k * (x1 - xb)) >= 0 THEN 'trend_adjusted' ELSE 'simple' END"
_TREND_DELTA = "CASE WHEN method = 'trend_adjusted' THEN ma - (mb + k * (xa - xb)) END"


@query(_compare_sql("true", _TREND, _TREND_DELTA))
def cmp_trend_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: monthly orders of every segment before and after one event."""
    return C.compare(_counts(spark, sf_dir), _event(spark, "E1", EFFECTIVE, SEGMENTS))


@query(
    _compare_sql(
        "scope = 'BUILDING'",
        f"CASE WHEN covered THEN 'diff_in_diff' ELSE {_TREND} END",
        f"CASE WHEN covered THEN (ma - mb) - (ca - cb) ELSE {_TREND_DELTA} END",
        "CASE WHEN covered THEN 'HOUSEHOLD' END",
        ", h AS (SELECT s, e, value AS c FROM m WHERE scope = 'HOUSEHOLD')",
        "LEFT JOIN h USING (s, e)",
    )
)
def cmp_diff_in_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.range(1).select(F.lit("E1").alias("event_id"), F.lit("BUILDING").alias("scope"), F.lit("HOUSEHOLD").alias("control_scope"), F.lit(True).alias("verified"), F.lit("same market").alias("reason"))
    return C.compare(_counts(spark, sf_dir), _event(spark, "E1", EFFECTIVE, ("BUILDING",)), control)


@query(
    f"""WITH {_M}, p AS (SELECT 'orders_count' AS metric, scope, s AS period_start, CASE WHEN e < DATE '{EFFECTIVE}' THEN 'before' WHEN s > DATE '{EFFECTIVE}' THEN 'after' ELSE 'crossing' END AS side FROM m WHERE scope IN ('BUILDING', 'MACHINERY'))
    SELECT scope, side, count(*) AS n, min(period_start) AS first_period, max(period_start) AS last_period FROM p GROUP BY ALL""",
    ("first_period", "last_period"),
)
def cmp_boundary_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.split_points(_counts(spark, sf_dir), _event(spark, "E1", EFFECTIVE, ("BUILDING", "MACHINERY")))
    return rows.groupBy("scope", "side").agg(F.count("*").alias("n"), F.min("start").alias("first_period"), F.max("start").alias("last_period"))


@query(
    f"""WITH {_M}, a AS (SELECT c_mktsegment AS scope, date_trunc('month', o_orderdate)::DATE AS s, count(DISTINCT o_custkey)::DOUBLE AS cap FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    p AS (SELECT scope, value / cap AS r, e < DATE '{EFFECTIVE}' AS b, s > DATE '{EFFECTIVE}' AS f FROM m JOIN a USING (scope, s))
    SELECT 'E1' AS event_id, 'orders_count' AS metric, scope, round(avg(r) FILTER (b), 6) AS before_per_capacity, round(avg(r) FILTER (f), 6) AS after_per_capacity,
      round(avg(r) FILTER (f) - avg(r) FILTER (b), 6) AS normalized_delta FROM p GROUP BY scope"""
)
def cmp_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    active = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy(F.col("c_mktsegment").alias("scope"), F.trunc("o_orderdate", "month").alias("start")).agg(F.count_distinct("o_custkey").cast("double").alias("value"))
    active = active.withColumn("end", F.last_day("start"))
    return C.normalized(_counts(spark, sf_dir), active, _event(spark, "E1", EFFECTIVE, SEGMENTS))


@query(
    f"""WITH {_M}, p AS (SELECT *, {_MID} AS mid, scope = 'BUILDING' AS a FROM m WHERE scope IN ('BUILDING', 'HOUSEHOLD') AND e < DATE '{EFFECTIVE}'),
    g AS (SELECT count(*) FILTER (a) AS n, count(*) FILTER (NOT a) AS n_control, coalesce(regr_slope(value, mid) FILTER (a), 0) AS k, coalesce(regr_slope(value, mid) FILTER (NOT a), 0) AS kc, avg(value) FILTER (a) AS mean, max(mid) - min(mid) AS days FROM p)
    SELECT 'E1' AS event_id, 'orders_count' AS metric, n, n_control, round(k, 8) AS slope, round(kc, 8) AS control_slope, n < 3 OR n_control < 3 OR abs(k - kc) * days > greatest(0.1 * abs(mean), 1) AS warn FROM g"""
)
def cmp_parallel_trend_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.parallel_trend(_counts(spark, sf_dir), "E1", EFFECTIVE, "BUILDING", "HOUSEHOLD")


_CHANGES_SQL = """ev AS (SELECT c_mktsegment || ':' || strftime(min(o_orderdate), '%Y-%m-%d') AS event_id, min(o_orderdate)::DATE AS effective, [c_mktsegment] AS units, min(o_orderdate)::DATE - 30 AS ws, min(o_orderdate)::DATE + 120 AS we
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY c_mktsegment, date_trunc('quarter', o_orderdate))"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of changes: the first urgent order of a segment in a quarter."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.where("o_orderpriority = '1-URGENT'").join(customer, orders["o_custkey"] == customer["c_custkey"])
    rows = rows.groupBy("c_mktsegment", F.trunc("o_orderdate", "quarter").alias("q")).agg(F.min("o_orderdate").cast("date").alias("effective"))
    return rows.select(F.concat_ws(":", "c_mktsegment", F.date_format("effective", "yyyy-MM-dd")).alias("event_id"), "effective", F.array("c_mktsegment").alias("units"))


@query(
    f"""WITH {_CHANGES_SQL} SELECT a.event_id, b.event_id AS other_id, date_diff('day', a.effective, b.effective) AS days, list_has_any(a.units, b.units) AS relevant
    FROM ev a JOIN ev b ON a.event_id <> b.event_id AND (b.effective BETWEEN a.ws AND a.we OR abs(date_diff('day', a.effective, b.effective)) <= 90)"""
)
def neighbor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _changes(spark, sf_dir)
    windows = events.select("event_id", F.date_sub("effective", 30).alias("window_start"), F.date_add("effective", 120).alias("window_end"))
    return C.neighbours(events, windows)


@query(
    """WITH y AS (SELECT c_mktsegment AS scope, year(o_orderdate) AS y, count(DISTINCT o_custkey)::DOUBLE AS staff FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) < 2001 GROUP BY ALL),
    g AS (SELECT scope, avg(staff) FILTER (y < 1998) AS b, avg(staff) FILTER (y > 1998) AS a FROM y GROUP BY scope)
    SELECT scope, round(b, 6) AS staff_before, round(a, 6) AS staff_after, NOT abs(a - b) <= 0.05 * greatest(abs(a), abs(b)) AS alternative FROM g"""
)
def staffing_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.where(F.year("o_orderdate") < 2001).join(customer, orders["o_custkey"] == customer["c_custkey"])
    rows = rows.groupBy(F.col("c_mktsegment").alias("scope"), F.year("o_orderdate").alias("y")).agg(F.count_distinct("o_custkey").cast("double").alias("staff"))
    rows = rows.groupBy("scope").agg(F.avg(F.when(F.col("y") < 1998, F.col("staff"))).alias("b"), F.avg(F.when(F.col("y") > 1998, F.col("staff"))).alias("a"))
    return rows.select("scope", F.round("b", 6).alias("staff_before"), F.round("a", 6).alias("staff_after"), (~close(F.col("a"), F.col("b"), 0.05)).alias("alternative"))


_ATTRIBUTED = f"""WITH {_M}, p AS (SELECT m.*, {_MID} AS mid, e < DATE '{EFFECTIVE}' AS b, s > DATE '{EFFECTIVE}' AS a FROM m),
    g AS (SELECT scope, count(*) FILTER (b) AS nb, count(*) FILTER (a) AS na, avg(value) FILTER (b) AS mb, avg(value) FILTER (a) AS ma, coalesce(regr_slope(value, mid) FILTER (b), 0) AS k, avg(mid) FILTER (b) AS xb, avg(mid) FILTER (a) AS xa, min(mid) FILTER (a) AS x0, max(mid) FILTER (a) AS x1 FROM p GROUP BY scope),
    t AS (SELECT *, {_TREND.replace('n_before', 'nb')} AS method FROM g),
    u AS (SELECT *, round(ma - mb, 6) AS d, round({_TREND_DELTA}, 6) AS adj, CASE WHEN scope < 'C' THEN 1 ELSE 0 END AS alt, scope <> 'FURNITURE' AS listed, scope <> 'MACHINERY' AS confirmed FROM t),
    o AS (SELECT *, CASE WHEN method = 'trend_adjusted' AND abs(adj) < 0.2 * abs(d) THEN 'refuted' WHEN alt > 0 THEN 'weakened' ELSE 'upheld' END AS outcome FROM u),
    l AS (SELECT scope, method, outcome, d, CASE WHEN nb < 2 OR na < 2 OR outcome = 'refuted' OR NOT listed THEN 'insufficient' WHEN NOT confirmed THEN 'low' WHEN outcome = 'weakened' AND method = 'simple' THEN 'low'
      WHEN method = 'trend_adjusted' AND outcome = 'upheld' AND alt = 0 THEN 'high' ELSE 'medium' END AS level FROM o)"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cmp_trend_adjusted(spark, sf_dir).withColumns(
        {"alternatives": F.when(F.col("scope") < "C", 1).otherwise(0), "listed": F.col("scope") != "FURNITURE", "confirmed": F.col("scope") != "MACHINERY", "assumption_warning": F.lit(False)}
    )
    return C.attribution_level(rows)


@query(f"{_ATTRIBUTED} SELECT scope, method, outcome, level FROM l")
def attribution_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("scope", "method", "outcome", "level")


@query(f"{_ATTRIBUTED}, x AS (SELECT scope, level, CASE WHEN d < 0 THEN 'low' ELSE 'high' END AS opinion FROM l), r AS (VALUES ('insufficient', 0), ('low', 1), ('medium', 2), ('high', 3)) SELECT scope, level, opinion, CASE WHEN r.col1 <= o.col1 THEN level ELSE opinion END AS final_level FROM x JOIN r ON r.col0 = level JOIN r o ON o.col0 = opinion")
def opinion_only_lowers(spark: SparkSession, sf_dir: str) -> DataFrame:
    opinion = F.when(F.col("delta_abs") < 0, "low").otherwise("high")
    return _attributed(spark, sf_dir).select("scope", "level", opinion.alias("opinion"), C.lower_level(F.col("level"), opinion).alias("final_level"))


_HYP_ROWS = [(f"H{i}", "E1", "orders_count", s, d, h) for i, (s, d, h) in enumerate([("BUILDING", "up", "2000-12-31"), ("HOUSEHOLD", "down", "2000-12-31"), ("FURNITURE", "down", "1999-12-31"), ("MACHINERY", "up", "2003-12-31"), ("AUTOMOBILE", "stable", "1998-07-31")])]
_HYP_SQL = f"""WITH {_M}, h(hypothesis_id, scope, direction, horizon) AS (VALUES {', '.join(f"('{r[0]}', '{r[3]}', '{r[4]}', DATE '{r[5]}')" for r in _HYP_ROWS)}),
    p AS (SELECT h.*, s, e, value, s > DATE '{EFFECTIVE}' AS a FROM h JOIN m USING (scope) WHERE (e < DATE '{EFFECTIVE}' OR s > DATE '{EFFECTIVE}') AND (e < DATE '{EFFECTIVE}' OR e <= horizon)),
    g AS (SELECT hypothesis_id, direction, horizon, count(*) FILTER (NOT a) AS nb, count(*) FILTER (a) AS na, avg(value) FILTER (NOT a) AS b, avg(value) FILTER (a) AS af, max(e) FILTER (a) AS l, min(s) FILTER (a) AS f, sum(date_diff('day', s, e) + 1) FILTER (a) AS days FROM p GROUP BY ALL),
    o AS (SELECT *, CASE WHEN af - b > 1e-9 THEN 'up' WHEN b - af > 1e-9 THEN 'down' ELSE 'stable' END AS observed FROM g),
    c AS (SELECT hypothesis_id, direction, observed, CASE WHEN DATE '2001-07-31' < horizon THEN 'pending' WHEN NOT (na >= 2 AND nb >= 2 AND l >= horizon AND date_diff('day', f, l) + 1 = days) THEN 'inconclusive' WHEN observed = direction THEN 'confirmed' ELSE 'refuted' END AS status FROM o)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_HYP_ROWS, "hypothesis_id string, event_id string, metric string, scope string, direction string, horizon string")
    return C.check_hypotheses(rows.withColumn("horizon", F.to_date("horizon")), _counts(spark, sf_dir), _event(spark, "E1", EFFECTIVE, SEGMENTS), "2001-07-31")


@query(f"{_HYP_SQL} SELECT * FROM c")
def hypothesis_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)


@query(f"{_HYP_SQL} SELECT count(*) FILTER (status = 'confirmed') AS confirmed, count(*) FILTER (status = 'refuted') AS refuted, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'inconclusive') AS inconclusive, round(count(*) FILTER (status = 'confirmed') / nullif(count(*) FILTER (status IN ('confirmed', 'refuted')), 0), 6) AS accuracy FROM c")
def hypothesis_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accuracy(_checked(spark, sf_dir))


@query(
    """WITH d AS (SELECT user_id, event_type, ts::DATE AS day, event_id, round(value, 0) AS v FROM events), r AS (SELECT *, first_value(v) OVER w AS f, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY user_id, event_type, day ORDER BY event_id)),
    c AS (SELECT *, min(CASE WHEN v <> f THEN k END) OVER (PARTITION BY user_id, event_type, day) AS k0 FROM r)
    SELECT event_id, CASE WHEN k0 IS NULL AND k = 1 THEN 'accepted' WHEN k0 IS NOT NULL AND (k = 1 OR k >= k0) THEN 'queued' ELSE 'repeat' END AS state FROM c"""
)
def series_conflict_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), F.round("value", 0).alias("v"))
    return S.conflict_queue(rows, ["user_id", "event_type", "day"], "event_id", "v").select("event_id", "state")


@query(
    """WITH v AS (SELECT event_type AS metric, (user_id % 7)::VARCHAR AS scope, date_trunc('month', ts)::DATE AS s, round(value, 0) AS value, CASE WHEN user_id % 5 = 0 THEN 'USD' WHEN user_id % 5 = 1 THEN '' ELSE 'usd ' END AS unit FROM events),
    u AS (SELECT metric, scope, count(DISTINCT nullif(lower(trim(unit)), '')) AS units FROM v GROUP BY ALL),
    g AS (SELECT metric, scope, s, min(value) AS lo, max(value) AS hi FROM v GROUP BY ALL)
    SELECT metric, scope, s AS period_start, CASE WHEN units > 1 THEN 'mixed_units' ELSE 'conflicting_values' END AS error FROM g JOIN u USING (metric, scope) WHERE units > 1 OR NOT abs(lo - hi) <= 1e-9 * greatest(abs(lo), abs(hi))""",
    ("period_start",),
)
def unit_consistency_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_errors(table(spark, sf_dir, "events"))


def _unit_errors(rows: DataFrame) -> DataFrame:
    unit = F.when(F.col("user_id") % 5 == 0, "USD").when(F.col("user_id") % 5 == 1, "").otherwise("usd ")
    start = F.trunc("ts", "month").cast("date")
    values = rows.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("metric"), (F.col("user_id") % 7).cast("string").alias("scope"), start.alias("start"), F.last_day(start).alias("end"), F.round("value", 0).alias("value"), unit.alias("unit"))
    return S.deduplicate(values)[1].select("metric", "scope", F.col("start").alias("period_start"), "error")


@query("SELECT o_custkey AS case_key, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey, arg_max(o_orderstatus, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderstatus FROM orders GROUP BY 1")
def case_upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_key"), "o_orderkey", "o_orderstatus", "o_orderdate")
    old, new = orders.where("o_orderdate < '1999-01-01'"), orders.where("o_orderdate >= '1999-01-01'")
    return R.upsert(old, new, ["case_key"], ["o_orderdate", "o_orderkey"]).select("case_key", "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey AS case_id, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def case_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    return R.retract(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey"), gone, ["case_id"])


_CASES_SQL = f"""WITH {_M}, y AS (SELECT scope, year(s) AS y, sum(value) AS v FROM m GROUP BY ALL HAVING count(*) = 12),
    c AS (SELECT scope, y, 'yearly' || (y % 2) AS pattern, (v - lag(v) OVER w) / abs(lag(v) OVER w) * 100 AS delta_pct FROM y WINDOW w AS (PARTITION BY scope ORDER BY y)),
    k AS (SELECT pattern, count(DISTINCT (y, scope)) AS n_cases, count(*) AS n, bool_and(delta_pct > 0) OR bool_and(delta_pct < 0) AS agree, count(delta_pct) AS known, avg(delta_pct) AS mean, min(delta_pct) AS lo, max(delta_pct) AS hi FROM c WHERE delta_pct IS NOT NULL GROUP BY pattern)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    years = S.rollup(_counts(spark, sf_dir), "year", "sum").where("reason is null").withColumn("y", F.year("start"))
    last = F.lag("value").over(Window.partitionBy("scope").orderBy("y"))
    rows = years.select("scope", F.concat(F.lit("yearly"), (F.col("y") % 2).cast("string")).alias("pattern"), F.col("start").alias("effective"), ((F.col("value") - last) / F.abs(last) * 100).alias("delta_pct"))
    return rows.where("delta_pct is not null")


@query(f"{_CASES_SQL} SELECT pattern, n_cases, coalesce(agree, false) AS signs_agree, CASE WHEN n_cases >= 3 AND n_cases = n AND known = n THEN round(mean, 6) END AS mean_delta_pct FROM k")
def knowledge_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.knowledge(_cases(spark, sf_dir)).select("pattern", "n_cases", "signs_agree", "mean_delta_pct")


@query(
    f"""{_CASES_SQL}, g AS (SELECT scope, avg(value) FILTER (e < DATE '{EFFECTIVE}') AS mb, avg(value) FILTER (s > DATE '{EFFECTIVE}') AS ma FROM m GROUP BY scope)
    SELECT scope, pattern, CASE WHEN n_cases >= 3 THEN 'compare_with_cases' ELSE 'discuss' END AS action, CASE WHEN n_cases >= 3 THEN round(lo, 6) END AS range_low, CASE WHEN n_cases >= 3 THEN round(hi, 6) END AS range_high
    FROM g CROSS JOIN (SELECT * FROM k WHERE pattern = 'yearly0') WHERE ma - mb < 0"""
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = C.compare(_counts(spark, sf_dir), _event(spark, "E1", EFFECTIVE, SEGMENTS)).withColumns({"pattern": F.lit("yearly0"), "better": F.lit("up")})
    return R.recommend(compared, R.knowledge(_cases(spark, sf_dir))).select("scope", "pattern", "action", "range_low", "range_high")
