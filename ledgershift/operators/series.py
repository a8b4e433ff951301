"""KPI series: identity checks, deduplication, calendar rollups with reasons, conflict queue.

Points: metric string, scope string, start date, end date, value double. All operators are one or two aggregations on
(metric, scope, period) keys, so the shuffle is the key's, with partial sums before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import close, finite
from ..functions.periods import bounds

KEY = ("metric", "scope")


def monthly_orders(orders: DataFrame, customer: DataFrame, before: str = "2001-08-01") -> DataFrame:
    """Monthly number of orders and revenue by market segment, in whole months before `before`."""
    rows = orders.where(F.col("o_orderdate") < F.lit(before).cast("timestamp")).join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    start, _ = bounds(F.col("o_orderdate"), "month")
    rows = rows.groupBy(F.col("c_mktsegment").alias("scope"), start.alias("start")).agg(F.count("*").cast("double").alias("orders_count"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return rows.select("scope", "start", F.last_day("start").alias("end"), "orders_count", "revenue")


def as_points(wide: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Columns of metrics -> one point a metric."""
    return wide.unpivot(["scope", "start", "end"], list(metrics), "metric", "value").select("metric", "scope", "start", "end", "value")


def rollup(points: DataFrame, granularity: str, aggregation: str) -> DataFrame:
    """metric, scope, start, end, value, n_points, reason: value is null where the bucket is not covered without gaps, with the reason.

    aggregation: sum, mean or last. Overlapping points give the reason "overlap".
    """
    first, last = bounds(F.col("start"), granularity)
    rows = points.withColumns({"b_start": first, "b_end": last})
    order = Window.partitionBy(*KEY, "b_start", "b_end").orderBy("start", "end")
    rows = rows.withColumn("step", F.datediff("start", F.lag("end").over(order)))
    value = {"sum": F.sum("value"), "mean": F.avg("value"), "last": F.max_by("value", "start")}[aggregation]
    out = rows.groupBy(*KEY, "b_start", "b_end").agg(
        value.alias("value"), F.count("*").alias("n_points"), F.min("start").alias("lo"), F.max("end").alias("hi"), F.max("step").alias("widest"), F.min("step").alias("closest")
    )
    reason = F.when(F.col("closest") < 1, "overlap").when(F.col("widest") > 1, "gap").when((F.col("lo") > F.col("b_start")) | (F.col("hi") < F.col("b_end")), "incomplete")
    return out.select(*KEY, F.col("b_start").alias("start"), F.col("b_end").alias("end"), F.when(reason.isNull(), F.col("value")).alias("value"), "n_points", reason.alias("reason"))


def reconcile(native: DataFrame, nested: DataFrame) -> DataFrame:
    """Native totals against rolled-up ones of the same period: metric, scope, start, end, native, nested, agrees (null: nested not complete)."""
    left = native.select(*KEY, "start", "end", F.col("value").alias("native"))
    right = nested.select(*KEY, "start", "end", F.col("value").alias("nested"))
    return left.join(right, [*KEY, "start", "end"], "left").withColumn("agrees", close(F.col("native"), F.col("nested"), 1e-9, 1e-9))


def deduplicate(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, errors) of values(id, metric, scope, start, end, value, unit): equal repeats merge their ids, others become errors.

    errors: metric, scope, start, end, error; one of not_finite, conflicting_values, mixed_units.
    """
    unit = F.nullif(F.lower(F.trim("unit")), F.lit(""))
    keyed = values.withColumn("u", unit)
    of_series = keyed.groupBy(*KEY).agg(F.count_distinct("u").alias("units"))
    rows = keyed.groupBy(*KEY, "start", "end").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.bool_and(finite(F.col("value"))).alias("ok"), F.array_sort(F.collect_set("id")).alias("ids"))
    rows = rows.join(of_series, list(KEY))
    error = F.when(~F.col("ok"), "not_finite").when(F.col("units") > 1, "mixed_units").when(~close(F.col("lo"), F.col("hi")), "conflicting_values")
    rows = rows.withColumn("error", error)
    return rows.where("error is null").select(*KEY, "start", "end", F.col("lo").alias("value"), "ids"), rows.where("error is not null").select(*KEY, "start", "end", "error")


def conflict_queue(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows with `state`: accepted (the first of its key), queued (a conflict: the first and all from the first different one on) or repeat."""
    by = Window.partitionBy(*keys)
    ordered = by.orderBy(order)
    rows = values.withColumn("first_value", F.first(value).over(ordered)).withColumn("rank", F.row_number().over(ordered))
    rows = rows.withColumn("conflict_at", F.min(F.when(F.col(value) != F.col("first_value"), F.col("rank"))).over(by))
    state = F.when(F.col("conflict_at").isNull() & (F.col("rank") == 1), "accepted").when(F.col("conflict_at").isNotNull() & ((F.col("rank") == 1) | (F.col("rank") >= F.col("conflict_at"))), "queued").otherwise("repeat")
    return rows.withColumn("state", state).drop("first_value", "rank", "conflict_at")
