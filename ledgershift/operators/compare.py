"""Before/after comparison of KPI series around structural events, attribution, hypotheses and recommendations.

One aggregation a comparison: both sides' means, the trend's slope and intercept, and the control's means come from the
same pass over (event, metric, scope), as a trend's mean prediction is the line at the mean midpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent_change
from ..functions.periods import midpoint

#: A change counts as one over 5 % of the mean before; events within 90 days are neighbours.
NOTABLE, NEIGHBOUR_DAYS = 0.05, 90
LEVELS = ("insufficient", "low", "medium", "high")
# Spellings of a unit of measure that is not known.
UNKNOWN_UNITS = ("", "?", "unknown", "неизвестно", "не указано")


def split_points(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points joined to the events that touch their scope and metric, with `side`: before, after, or crossing (neither, strictly)."""
    touched = events.select("event_id", "effective", F.explode("units").alias("scope"), "metric_codes")
    rows = points.join(touched, "scope").where((F.size("metric_codes") == 0) | F.array_contains("metric_codes", F.col("metric")))
    side = F.when(F.col("end") < F.col("effective"), "before").when(F.col("start") > F.col("effective"), "after").otherwise("crossing")
    return rows.withColumn("side", side).drop("metric_codes")


def usable_controls(rows: DataFrame, events: DataFrame, controls: DataFrame, units: DataFrame | None) -> DataFrame:
    """(event_id, metric, scope, control_scope) of controls that are verified with a reason, of the same single known unit, and untouched.

    Untouched: not by the event itself, nor by any other event between the first day before and the last day after that
    the comparison uses. units: metric, scope, unit of the series.
    """
    fine = controls.where("verified and trim(reason) <> '' and control_scope <> scope").select("event_id", "scope", "control_scope")
    touch = events.select(F.col("event_id").alias("other_id"), F.col("effective").alias("other_day"), F.explode("units").alias("control_scope"))
    fine = fine.join(touch.select(F.col("other_id").alias("event_id"), "control_scope"), ["event_id", "control_scope"], "left_anti")
    window = rows.where("side <> 'crossing'").groupBy("event_id", "metric", "scope").agg(F.min("start").alias("first_day"), F.max("end").alias("last_day"))
    fine = window.join(fine, ["event_id", "scope"])
    hit = fine.join(touch, "control_scope").where((F.col("other_id") != F.col("event_id")) & F.col("other_day").between(F.col("first_day"), F.col("last_day")))
    fine = fine.join(hit.select("event_id", "metric", "scope", "control_scope").distinct(), ["event_id", "metric", "scope", "control_scope"], "left_anti")
    if units is not None:
        one = units.groupBy("metric", "scope").agg(F.collect_set(F.trim(F.coalesce("unit", F.lit("")))).alias("u"))
        known = one.where((F.size("u") == 1) & ~F.lower(F.get("u", 0)).isin(*UNKNOWN_UNITS)).select("metric", "scope", F.get("u", 0).alias("u"))
        fine = fine.join(known, ["metric", "scope"]).join(known.withColumnRenamed("scope", "control_scope"), ["metric", "control_scope", "u"])
    return fine.select("event_id", "metric", "scope", "control_scope")


def compare(points: DataFrame, events: DataFrame, controls: DataFrame | None = None, percent_metrics: tuple[str, ...] = (), units: DataFrame | None = None) -> DataFrame:
    """One row a (event, metric, scope) with points on both sides.

    controls: event_id, scope, control_scope, verified, reason; see usable_controls. A usable control with a point for
    each one used makes the method diff_in_diff; else it is trend_adjusted with three points before and predictions in
    range, else simple.
    """
    rows = split_points(points, events).withColumn("mid", midpoint(F.col("start"), F.col("end")))
    if controls is None:
        rows = rows.withColumns({"control_scope": F.lit(None).cast("string"), "c": F.lit(None).cast("double")})
    else:
        fine = usable_controls(rows, events, controls, units)
        other = points.select("metric", F.col("scope").alias("control_scope"), "start", "end", F.col("value").alias("c"))
        rows = rows.join(fine, ["event_id", "metric", "scope"], "left").join(other, ["metric", "control_scope", "start", "end"], "left")
    before, after, used = F.col("side") == "before", F.col("side") == "after", F.col("side") != "crossing"

    def at(condition: Column, x: str) -> Column:
        return F.when(condition, F.col(x))

    out = rows.groupBy("event_id", "metric", "scope").agg(
        F.count_if(before).alias("n_before"),
        F.count_if(after).alias("n_after"),
        F.count_if(~used).alias("n_excluded"),
        F.avg(at(before, "value")).alias("mean_before"),
        F.avg(at(after, "value")).alias("mean_after"),
        F.coalesce(F.regr_slope(at(before, "value"), at(before, "mid")), F.lit(0.0)).alias("slope"),
        F.avg(at(before, "mid")).alias("mid_before"),
        F.avg(at(after, "mid")).alias("mid_after"),
        F.min(at(after, "mid")).alias("mid_first"),
        F.max(at(after, "mid")).alias("mid_last"),
        F.max("control_scope").alias("control"),
        F.bool_and(F.col("c").isNotNull() | ~used).alias("covered"),
        F.avg(at(before, "c")).alias("c_before"),
        F.avg(at(after, "c")).alias("c_after"),
    )
    out = out.where("n_before > 0 and n_after > 0")
    line = [F.col("mean_before") + F.col("slope") * (F.col(x) - F.col("mid_before")) for x in ("mid_after", "mid_first", "mid_last")]
    sane = (F.least(*line[1:]) >= 0) & (~F.col("metric").isin(*percent_metrics) | (F.greatest(*line[1:]) <= 100) if percent_metrics else F.lit(True))
    did = F.col("control").isNotNull() & F.col("covered")
    method = F.when(did, "diff_in_diff").when((F.col("n_before") >= 3) & sane, "trend_adjusted").otherwise("simple")
    delta = F.col("mean_after") - F.col("mean_before")
    adjusted = F.when(method == "diff_in_diff", delta - (F.col("c_after") - F.col("c_before"))).when(method == "trend_adjusted", F.col("mean_after") - line[0])
    return out.select(
        "event_id", "metric", "scope", "n_before", "n_after", "n_excluded",
        F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), F.round(delta, 6).alias("delta_abs"),
        F.round(percent_change(F.col("mean_before"), delta), 6).alias("delta_pct"), method.alias("method"),
        F.when(did, F.col("control")).alias("control_scope"), F.round(adjusted, 6).alias("adjusted_delta"),
        (F.abs(delta) > F.greatest(F.lit(NOTABLE) * F.abs("mean_before"), F.lit(1e-9))).alias("descriptive_change"),
    )


def normalized(points: DataFrame, capacity: DataFrame, events: DataFrame) -> DataFrame:
    """Mean of value per capacity on each side; null unless every period used has a positive capacity."""
    per = capacity.select("scope", "start", "end", F.col("value").alias("capacity"))
    rows = split_points(points, events).where("side <> 'crossing'").join(per, ["scope", "start", "end"], "left")
    out = rows.groupBy("event_id", "metric", "scope").agg(
        F.bool_and(F.coalesce(F.col("capacity") > 0, F.lit(False))).alias("ok"),
        F.avg(F.when(F.col("side") == "before", F.col("value") / F.nullif("capacity", F.lit(0.0)))).alias("b"),
        F.avg(F.when(F.col("side") == "after", F.col("value") / F.nullif("capacity", F.lit(0.0)))).alias("a"),
    )
    return out.select("event_id", "metric", "scope", *(F.round(F.when(F.col("ok"), x), 6).alias(n) for n, x in (("before_per_capacity", F.col("b")), ("after_per_capacity", F.col("a")), ("normalized_delta", F.col("a") - F.col("b")))))


def parallel_trend(points: DataFrame, event_id: str, effective: str, scope: str, control: str) -> DataFrame:
    """Slopes of both series before the event, and whether to warn: under three points, or drifting apart by over a tenth of the mean."""
    rows = points.where(F.col("scope").isin(scope, control) & (F.col("end") < F.to_date(F.lit(effective)))).withColumn("mid", midpoint(F.col("start"), F.col("end")))
    mine, other = F.col("scope") == scope, F.col("scope") == control
    out = rows.groupBy("metric").agg(
        F.count_if(mine).alias("n"), F.count_if(other).alias("n_control"),
        F.coalesce(F.regr_slope(F.when(mine, F.col("value")), F.when(mine, F.col("mid"))), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_slope(F.when(other, F.col("value")), F.when(other, F.col("mid"))), F.lit(0.0)).alias("control_slope"),
        F.avg(F.when(mine, F.col("value"))).alias("mean"), (F.max("mid") - F.min("mid")).alias("days"),
    )
    drift = F.abs(F.col("slope") - F.col("control_slope")) * F.col("days") > F.greatest(F.lit(0.1) * F.abs("mean"), F.lit(1.0))
    return out.select(F.lit(event_id).alias("event_id"), "metric", "n", "n_control", F.round("slope", 8).alias("slope"), F.round("control_slope", 8).alias("control_slope"), ((F.col("n") < 3) | (F.col("n_control") < 3) | drift).alias("warn"))


def neighbours(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of different events where the other lies inside the event's window or within 90 days: an interval join on 90-day slots.

    events: event_id, effective, units; windows: event_id, window_start, window_end. The slot key keeps the join an
    equi-join; a window's slots are exploded, so its length in slots is the only growth.
    """
    day = F.datediff("effective", F.to_date(F.lit("1970-01-01")))
    span = events.join(windows, "event_id").select(F.col("event_id"), "effective", "units", "window_start", "window_end")
    low = F.least(F.col("window_start"), F.date_sub("effective", NEIGHBOUR_DAYS))
    high = F.greatest(F.col("window_end"), F.date_add("effective", NEIGHBOUR_DAYS))
    slot = lambda d: F.floor(F.datediff(d, F.to_date(F.lit("1970-01-01"))) / NEIGHBOUR_DAYS)
    left = span.withColumn("slot", F.explode(F.sequence(slot(low), slot(high))))
    right = events.select(F.col("event_id").alias("other_id"), F.col("effective").alias("other_effective"), F.col("units").alias("other_units"), F.floor(day / NEIGHBOUR_DAYS).alias("slot"))
    both = left.join(right, "slot").where(F.col("event_id") != F.col("other_id"))
    inside = F.col("other_effective").between(F.col("window_start"), F.col("window_end"))
    near = F.abs(F.datediff("effective", "other_effective")) <= NEIGHBOUR_DAYS
    relevant = (F.size("other_units") == 0) | F.arrays_overlap("units", "other_units")
    return both.where(inside | near).select("event_id", "other_id", F.datediff("other_effective", "effective").alias("days"), relevant.alias("relevant"))


def outcome(comparisons: DataFrame) -> Column:
    """What the opposing review says: refuted, weakened or upheld. Needs columns method, adjusted_delta, delta_abs, alternatives."""
    small = (F.col("method") == "trend_adjusted") & (F.abs("adjusted_delta") < 0.2 * F.abs("delta_abs"))
    return F.when(small, "refuted").when(F.col("alternatives") > 0, "weakened").otherwise("upheld")


def attribution_level(comparisons: DataFrame) -> DataFrame:
    """Adds outcome and level. Needs n_before, n_after, method, alternatives, listed, confirmed, assumption_warning."""
    rows = comparisons.withColumn("outcome", outcome(comparisons))
    held = F.when((F.col("outcome") == "upheld") & F.col("assumption_warning"), "weakened").otherwise(F.col("outcome"))
    level = (
        F.when((F.col("n_before") < 2) | (F.col("n_after") < 2), "insufficient")
        .when(F.col("outcome") == "refuted", "insufficient")
        .when(~F.col("listed"), "insufficient")
        .when(~F.col("confirmed"), "low")
        .when((held == "weakened") & (F.col("method") == "simple"), "low")
        .when(F.col("method").isin("diff_in_diff", "trend_adjusted") & (held == "upheld") & (F.col("alternatives") == 0), "high")
        .when(held.isin("upheld", "weakened"), "medium")
        .otherwise("low")
    )
    return rows.withColumn("level", level)


def lower_level(a: Column, b: Column) -> Column:
    """The lower of two levels: an outside opinion can only lower one."""
    order = F.create_map(*(F.lit(x) for i, name in enumerate(LEVELS) for x in (name, i)))
    return F.when(order[a] <= order[b], a).otherwise(b)


def check_hypotheses(hypotheses: DataFrame, points: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Adds status (pending, confirmed, refuted, inconclusive) to hypotheses(hypothesis_id, event_id, metric, scope, direction, horizon)."""
    rows = split_points(points, events).where("side <> 'crossing'")
    rows = hypotheses.join(rows, ["event_id", "metric", "scope"]).where((F.col("side") == "before") | (F.col("end") <= F.col("horizon")))
    after = F.col("side") == "after"
    out = rows.groupBy("hypothesis_id", "direction", "horizon").agg(
        F.count_if(~after).alias("nb"), F.count_if(after).alias("na"), F.avg(F.when(~after, F.col("value"))).alias("b"), F.avg(F.when(after, F.col("value"))).alias("a"),
        F.max(F.when(after, F.col("end"))).alias("last"), F.min(F.when(after, F.col("start"))).alias("first"), F.sum(F.when(after, F.datediff("end", "start") + 1)).alias("days"),
    )
    whole = (F.col("na") >= 2) & (F.col("nb") >= 2) & (F.col("last") >= F.col("horizon")) & (F.datediff("last", "first") + 1 == F.col("days"))
    seen = F.when(F.col("a") - F.col("b") > 1e-9, "up").when(F.col("b") - F.col("a") > 1e-9, "down").otherwise("stable")
    status = F.when(F.to_date(F.lit(as_of)) < F.col("horizon"), "pending").when(~whole, "inconclusive").when(seen == F.col("direction"), "confirmed").otherwise("refuted")
    return out.select("hypothesis_id", "direction", seen.alias("observed"), status.alias("status"))


def accuracy(checked: DataFrame) -> DataFrame:
    """Share of confirmed among decided hypotheses; null if none is decided."""
    sure, no = F.count_if(F.col("status") == "confirmed"), F.count_if(F.col("status") == "refuted")
    return checked.agg(sure.alias("confirmed"), no.alias("refuted"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "inconclusive").alias("inconclusive"), F.round(F.when(sure + no > 0, sure / (sure + no)), 6).alias("accuracy"))
