"""KPI runs: validation, namespaces, series that can be compared, the chain of stages with snapshots, decisions, mechanisms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.text import clip
from . import compare as C
from . import registry as G
from .claims import first_reason
from .numbering import numbered

STAGES = ("M1_ingest", "M2_events", "M3_alignment", "M4_compare", "M5_attribute", "M6_hypotheses", "M7_knowledge", "M8_recommend", "M9_report")
DECISIONS = ("accept", "reject", "discuss")
GRANULARITIES = ("month", "quarter", "year")
# Fixed value: the metric that a chart opens with.
FAVOURITE = "report_delay_days"
# Settings that switch the module off.
OFF = ("off", "0", "false", "no")


def enabled(settings: dict[str, str]) -> bool:
    """Whether the KPI module is on; only the four words switch it off."""
    return settings.get("METRICS_MODULE", "on").casefold() not in OFF


def namespace_state(*tables: DataFrame) -> DataFrame:
    """synthetic, real, homogeneous over the flag `synthetic` of all tables of a run."""
    rows = tables[0].select("synthetic")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("synthetic"))
    out = rows.agg(F.count_if("synthetic").alias("n_synthetic"), F.count_if(~F.col("synthetic")).alias("n_real"))
    return out.withColumn("homogeneous", (F.col("n_synthetic") == 0) | (F.col("n_real") == 0))


def invalid_values(values: DataFrame) -> DataFrame:
    """id, reason of values(id, metric, scope, start, end, value, file, quote, cell) that a run may not use; a repeated id is one."""
    n = F.count("*").over(Window.partitionBy("id"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = first_reason(repeated_id=F.col("n") > 1, source=blank("file") | blank("quote") | blank("cell"), number=~finite(F.col("value")), scope_or_metric=blank("scope") | blank("metric"), period=~F.coalesce(F.col("start") <= F.col("end"), F.lit(False)))
    return values.withColumn("n", n).select("id", reason.alias("reason")).where("reason is not null").distinct()


def invalid_events(events: DataFrame) -> DataFrame:
    """event_id, reason of events(event_id, effective, mechanism, confirmed, quotes): repeated, undated, or confirmed without words or quotes."""
    n = F.count("*").over(Window.partitionBy("event_id"))
    unsaid = F.col("confirmed") & ((F.coalesce(F.trim("mechanism"), F.lit("")) == "") | (F.size("quotes") < 1))
    reason = first_reason(repeated_id=F.col("n") > 1, date=F.col("effective").isNull(), mechanism=F.coalesce(unsaid, F.lit(False)))
    return events.withColumn("n", n).select("event_id", reason.alias("reason")).where("reason is not null").distinct()


def comparable_series(values: DataFrame, like_metric: str, like_scope: str) -> DataFrame:
    """metric, scope, granularity, unit, n of series that one chart can hold with a given one: its metric, granularity and unit."""
    rows = values.select("metric", "scope", "granularity", F.trim("unit").alias("unit"))
    chosen = rows.where((F.col("metric") == like_metric) & (F.col("scope") == like_scope)).groupBy("metric", "granularity", "unit").agg(F.count("*").alias("k"))
    best = Window.partitionBy("metric").orderBy(F.desc("k"), F.array_position(F.array(*(F.lit(x) for x in GRANULARITIES)), F.col("granularity")), "unit")
    default = chosen.withColumn("r", F.row_number().over(best)).where("r = 1").select("metric", "granularity", "unit")
    return rows.join(default, ["metric", "granularity", "unit"]).groupBy("metric", "scope", "granularity", "unit").agg(F.count("*").alias("n"))


def default_chart(values: DataFrame, compared: str | None = None, favourite: str = FAVOURITE) -> DataFrame:
    """metric, granularity, unit that a chart opens with, one row, none without values(metric, granularity, unit).

    The favourite metric if it has values, else the first compared one, else the first by code; its most frequent
    granularity (ties: the finer), then that granularity's most frequent unit.
    """
    n = values.groupBy("metric", "granularity", F.trim(F.coalesce("unit", F.lit(""))).alias("unit")).agg(F.count("*").alias("n"))
    place = F.when(F.col("metric") == favourite, 0).when(F.col("metric") == F.lit(compared), 1).otherwise(2)
    fine = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in GRANULARITIES)), F.col("granularity")), F.lit(0)), F.lit(9))
    n = n.withColumn("of_granularity", F.sum("n").over(Window.partitionBy("metric", "granularity")))
    return n.orderBy(place, "metric", F.desc("of_granularity"), fine, "granularity", F.desc("n"), "unit").select("metric", "granularity", "unit").limit(1)


def chart_rows(values: DataFrame, chart: DataFrame, controls: DataFrame) -> DataFrame:
    """scope, role, start, value of the chart's metric, granularity and unit; a scope among controls(scope) is a control group."""
    rows = values.withColumn("unit", F.trim(F.coalesce("unit", F.lit("")))).join(F.broadcast(chart), ["metric", "granularity", "unit"])  # one row
    rows = rows.join(controls.select("scope", F.lit("control").alias("role")).distinct(), "scope", "left")
    return rows.select("scope", F.coalesce("role", F.lit("observed")).alias("role"), "start", "value")


def allowed_metrics(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """metric, allowed: catalogued, or every value of it confirmed by a human."""
    by = values.groupBy("metric").agg(F.bool_and(F.coalesce("confirmed", F.lit(False))).alias("confirmed"))
    known = catalogue.select(F.col("code").alias("metric"), F.lit(True).alias("known")).distinct()
    return by.join(known, "metric", "left").select("metric", (F.coalesce("known", F.lit(False)) | F.col("confirmed")).alias("allowed"))


def distinct_warnings(warnings: DataFrame, synthetic: bool) -> DataFrame:
    """place, warning: each warning(ord, warning) once, in first-seen order, with the mark of synthetic data in front."""
    first = warnings.groupBy("warning").agg(F.min("ord").alias("ord"))
    if synthetic:
        mark = warnings.sparkSession.range(1).select(F.lit("synthetic data: effects are made, not measured").alias("warning"), F.lit(-1).cast("long").alias("ord"))
        first = first.unionByName(mark.select("warning", F.col("ord").cast(first.schema["ord"].dataType)))
    return numbered(first, "ord", "warning", name="place").select("place", "warning")


def run(points: DataFrame, events: DataFrame, controls: DataFrame, hypotheses: DataFrame, as_of: str, staffing: dict[str, tuple[str, ...]] | None = None, units: DataFrame | None = None) -> dict[str, DataFrame]:
    """Stage name -> table: comparisons, attributions with levels, checked hypotheses.

    events: event_id, effective, units, metric_codes, confirmed. A neighbouring relevant event, and any event of type
    staffing that changes the scope, is an alternative explanation. staffing: event_id -> scopes whose staff changed.
    """
    compared = C.compare(points, events.select("event_id", "effective", "units", "metric_codes"), controls, units=units)
    window = points.agg(F.min("start").alias("window_start"), F.max("end").alias("window_end"))
    windows = events.select("event_id").crossJoin(F.broadcast(window))  # one row of two dates
    near = C.neighbours(events.select("event_id", "effective", "units"), windows).where("relevant").groupBy("event_id").agg(F.count("*").alias("alternatives"))
    listed = events.select("event_id", "confirmed", (F.size("metric_codes") > 0).alias("listed"))
    rows = compared.join(listed, "event_id").join(near, "event_id", "left")
    rows = rows.withColumns({"alternatives": F.coalesce("alternatives", F.lit(0)), "assumption_warning": F.lit(False)})
    return {"M4_compare": compared, "M5_attribute": C.attribution_level(rows), "M6_hypotheses": C.check_hypotheses(hypotheses, points, events.select("event_id", "effective", "units", "metric_codes"), as_of)}


def stages(points: DataFrame, events: DataFrame, controls: DataFrame, hypotheses: DataFrame, cases: DataFrame, better: str, as_of: str) -> dict[str, DataFrame]:
    """All nine stages of a run, by name; see run(). cases: pattern, scope, effective, delta_pct of earlier runs; better: the good direction of the metrics.

    M3 is the alignment (points with the side of each event that touches them), M7 what earlier cases say of a pattern, M8
    an action for each adverse change, M9 the number of rows of the others.
    """
    plain = events.select("event_id", "effective", "units", "metric_codes")
    found = run(points, events, controls, hypotheses, as_of)
    known = G.knowledge(cases)
    changed = found["M4_compare"].withColumns({"better": F.lit(better), "pattern": F.concat_ws(":", "event_id", "metric")})
    out = {
        "M1_ingest": points, "M2_events": events, "M3_alignment": C.split_points(points, plain), "M4_compare": found["M4_compare"], "M5_attribute": found["M5_attribute"],
        "M6_hypotheses": found["M6_hypotheses"], "M7_knowledge": known, "M8_recommend": G.recommend(changed, known),
    }
    lines = None
    for name, rows in out.items():
        line = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        lines = line if lines is None else lines.unionByName(line)
    return out | {"M9_report": lines}


def save_decisions(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """recommendation_id, decision, error: a decision counts if it is one of three and its recommendation exists."""
    rows = decisions.join(recommendations.select("recommendation_id", F.lit(True).alias("known")).distinct(), "recommendation_id", "left")
    error = first_reason(decision=~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), recommendation=F.col("known").isNull())
    return rows.select("recommendation_id", "decision", error.alias("error"))


def mechanism_key(events: DataFrame) -> DataFrame:
    """events(event_id, type, units, quotes, ...) with the key of what they say: equal events of later runs have it too."""
    return events.withColumn("mechanism_key", F.substring(F.sha2(F.to_json(F.struct("type", F.array_sort("units").alias("u"), "quotes")), 256), 1, 24))


def cache_mechanisms(cache: DataFrame, events: DataFrame) -> DataFrame:
    """cache(namespace, mechanism_key, mechanism, metric_codes) after a run: confirmed mechanisms replace, unconfirmed ones delete."""
    seen = mechanism_key(events).select("namespace", "mechanism_key", "mechanism", "metric_codes", "confirmed")
    kept = cache.join(seen.select("namespace", "mechanism_key").distinct(), ["namespace", "mechanism_key"], "left_anti")
    return kept.unionByName(seen.where("confirmed").drop("confirmed"))


def apply_mechanisms(events: DataFrame, cache: DataFrame) -> DataFrame:
    """events with the mechanism, metric codes and confirmation that the cache has for the same namespace and key."""
    known = cache.select("namespace", "mechanism_key", F.col("mechanism").alias("m"), F.col("metric_codes").alias("c"))
    rows = mechanism_key(events).join(known, ["namespace", "mechanism_key"], "left")
    return rows.withColumns({"mechanism": F.coalesce("m", "mechanism"), "metric_codes": F.coalesce("c", "metric_codes"), "confirmed": F.col("confirmed") | F.col("m").isNotNull()}).drop("m", "c")


def event_edit_errors(events: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """event_id, reason of edits(event_id, date_confirmed, effective, metric_codes, mechanism, confirmed, quotes)."""
    known = F.array(*(F.lit(c) for c in codes))
    reason = first_reason(
        date=~F.col("date_confirmed") | F.col("effective").isNull(), codes=F.size(F.array_except("metric_codes", known)) > 0,
        mechanism=F.col("confirmed") & (F.coalesce(F.trim("mechanism"), F.lit("")) == ""), quotes=F.col("confirmed") & (F.size("quotes") < 1), metrics=F.col("confirmed") & (F.size("metric_codes") < 1),
    )
    return events.select("event_id", F.coalesce(reason, F.lit("accepted")).alias("reason"))


def hypothesis_errors(hypotheses: DataFrame, events: DataFrame) -> DataFrame:
    """hypothesis_id, reason of manual hypotheses(hypothesis_id, event_id, prediction, direction, horizon): they need words, a known event, a direction and a date after it."""
    rows = hypotheses.join(events.select("event_id", "effective"), "event_id", "left")
    reason = first_reason(prediction=F.coalesce(F.trim("prediction"), F.lit("")) == "", event=F.col("effective").isNull(), direction=~F.coalesce(F.col("direction").isin("up", "down", "stable"), F.lit(False)), horizon=~F.coalesce(F.col("horizon") > F.col("effective"), F.lit(False)))
    return rows.select("hypothesis_id", F.coalesce(reason, F.lit("accepted")).alias("reason"))


def drill_down(attributions: DataFrame, values: DataFrame) -> DataFrame:
    """attribution_id with each value that its evidence names. attributions: attribution_id, metric_ids."""
    return attributions.select("attribution_id", F.explode("metric_ids").alias("id")).join(values, "id")


def comparison_actions(comparisons: DataFrame) -> DataFrame:
    """Adds `action` by the two rules: an adverse change of a confirmed mechanism is to be restored or discussed, any other attributed one watched.

    comparisons: better, delta_abs, level, event_type.
    """
    bad = ((F.col("better") == "up") & (F.col("delta_abs") < 0)) | ((F.col("better") == "down") & (F.col("delta_abs") > 0))
    sure = F.col("level").isin("medium", "high")
    weak = F.col("event_type").isin("func_weakened", "func_lost")
    return comparisons.withColumn("action", F.when(bad & sure & weak, "restore_requirement").when(bad & sure, "discuss_capacity"))


def report_lines(run_id: str, synthetic: bool, parts: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """place, line: a Markdown report whose every line carries the namespace; parts: heading, rows, and a row's text."""
    label = F.lit(("SYNTHETIC DATA" if synthetic else "REPORT DATA") + " · ")
    out = None
    for i, (heading, rows, text) in enumerate(parts):
        spark = rows.sparkSession
        head = spark.range(1).select(F.lit(i).alias("part"), F.lit(0).alias("kind"), F.concat(label, F.lit(f"{heading} ({run_id})")).alias("line"))
        body = rows.select(F.lit(i).alias("part"), F.lit(1).alias("kind"), F.concat(label, clip(F.regexp_replace(text, "\n", " / "), 15_000)).alias("line"))
        some = head.unionByName(body)
        out = some if out is None else out.unionByName(some)
    return numbered(out, "part", "kind", "line", name="place").select("place", "line")
