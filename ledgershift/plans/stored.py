"""Queries through storage and streams: runs, merged tables, pair re-binding, day buckets of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as U
from ..operators import scoring as S
from ..operators import store, streams
from ..session import scratch_path
from .base import query, table
from .kpi import _M, EFFECTIVE, SEGMENTS, _counts, _event


@query(f"""WITH {_M}, p AS (SELECT *, CASE WHEN e < DATE '{EFFECTIVE}' THEN 'before' WHEN s > DATE '{EFFECTIVE}' THEN 'after' ELSE 'crossing' END AS side FROM m),
    c AS (SELECT scope, avg(value) FILTER (side = 'after') - avg(value) FILTER (side = 'before') AS d FROM p GROUP BY scope HAVING count(DISTINCT side) FILTER (side <> 'crossing') = 2),
    n AS (SELECT (SELECT count(*) FROM m) AS points, (SELECT count(*) FROM c) AS compared)
    SELECT stage, CASE stage WHEN 'M1_ingest' THEN points WHEN 'M2_events' THEN 1 WHEN 'M3_alignment' THEN points WHEN 'M4_compare' THEN compared WHEN 'M5_attribute' THEN compared WHEN 'M6_hypotheses' THEN 1
      WHEN 'M7_knowledge' THEN (SELECT count(DISTINCT scope) FROM m) WHEN 'M8_recommend' THEN (SELECT count(*) FROM c WHERE d < 0) ELSE 8 END::BIGINT AS n_rows
    FROM n, unnest(['M1_ingest', 'M2_events', 'M3_alignment', 'M4_compare', 'M5_attribute', 'M6_hypotheses', 'M7_knowledge', 'M8_recommend', 'M9_report']) AS t(stage)""")
def kpi_run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A KPI run over all orders: nine stages written as one whole, found by its manifest and counted as read back."""
    points = _counts(spark, sf_dir).where("metric = 'orders_count'")
    events = _event(spark, "E1", EFFECTIVE, SEGMENTS).withColumns({"confirmed": F.lit(True)})
    controls = spark.createDataFrame([], "event_id string, scope string, control_scope string, verified boolean, reason string")
    hypotheses = events.select(F.lit("H1").alias("hypothesis_id"), "event_id", F.lit("orders_count").alias("metric"), F.lit(SEGMENTS[0]).alias("scope"), F.lit("up").alias("direction"), F.lit("2001-06-30").cast("date").alias("horizon"))
    cases = points.select(F.col("scope").alias("pattern"), "scope", F.col("start").alias("effective"), (F.col("value") - 100).alias("delta_pct"))
    root = scratch_path(spark, "runs")
    store.write_run(U.stages(points, events, controls, hypotheses, cases, "up", "2001-07-31"), root, "orders", False)
    out = None
    for name, rows in store.read_run(spark, root, "orders", False).items():
        line = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows")
        out = line if out is None else out.unionByName(line)
    return out


@query("""SELECT o_custkey, arg_max(o_orderkey, v) AS o_orderkey, max(v) AS version FROM (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT * 10000000 + o_orderkey AS v, o_orderdate FROM orders) GROUP BY o_custkey
    HAVING count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderkey % 10 = 0) = 0""")
def stored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order, stored from the orders before 2000 and merged with two change sets; an order of 2001 whose key ends in 0 takes its customer out."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.unix_timestamp("o_orderdate") * 10_000_000 + F.col("o_orderkey")).alias("version"))
    late = F.col("o_orderdate") >= "2001-01-01"
    path = scratch_path(spark, "customers")
    newest = lambda some: some.groupBy("o_custkey").agg(F.max_by("o_orderkey", "version").alias("o_orderkey"), F.max("version").alias("version"))
    store.create_table(newest(rows.where(F.col("o_orderdate") < "2000-01-01")), path, "o_custkey", 16)
    store.merge(path, newest(rows.where((F.col("o_orderdate") >= "2000-01-01") & ~late)).withColumn("gone", F.lit(False)), "o_custkey", "version", 16)
    leaving = rows.where(late).groupBy("o_custkey").agg(F.max_by("o_orderkey", "version").alias("o_orderkey"), F.max("version").alias("version"), F.bool_or(F.col("o_orderkey") % 10 == 0).alias("gone"))
    store.merge(path, leaving, "o_custkey", "version", 16)
    return spark.read.schema("o_custkey long, o_orderkey long, version long").parquet(path).select("o_custkey", "o_orderkey", "version")


@query("""WITH f AS (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS id, 'u' || l_suppkey % 3 AS unit, CASE l_returnflag WHEN 'R' THEN 'control' WHEN 'A' THEN 'execute' ELSE 'agree' END AS role, CASE l_linestatus WHEN 'O' THEN 'x' ELSE '' END AS scope, l_partkey FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)),
    n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN list_sort(list(id))[1:2] ELSE [] END AS ids FROM orders JOIN f ON l_orderkey = o_orderkey GROUP BY o_orderkey),
    i AS (SELECT o_orderkey, ids, f.* FROM n JOIN f ON l_orderkey = o_orderkey WHERE len(ids) = 0 OR list_contains(ids, id)),
    p AS (SELECT a.o_orderkey, a.unit, a.id::VARCHAR AS x, b.id::VARCHAR AS y, -abs(a.l_partkey - b.l_partkey) AS signal FROM i a JOIN i b ON a.o_orderkey = b.o_orderkey AND a.unit = b.unit AND a.id <> b.id AND a.role = 'execute' AND b.role = 'control' AND a.scope = b.scope OR a.o_orderkey = b.o_orderkey AND a.unit = b.unit AND a.role = 'execute' AND b.role = 'control' AND (a.scope = '' OR b.scope = '') AND a.scope <> b.scope),
    g AS (SELECT o_orderkey, count(*) AS n_pairs, count(DISTINCT unit) AS n_units, arg_min({'x': x, 'y': y}, {'s': -signal, 'x': x, 'y': y}) AS best FROM p GROUP BY o_orderkey),
    r AS (SELECT n.o_orderkey, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_units, 0) AS n_units, best, CASE WHEN len(ids) > 0 AND (len(ids) <> 2 OR n_pairs IS NULL) THEN 'unbound' WHEN len(ids) = 0 AND n_units > 1 THEN 'ambiguous' WHEN n_pairs IS NULL THEN 'no_pair' END AS issue FROM n LEFT JOIN g USING (o_orderkey))
    SELECT o_orderkey AS finding_id, n_pairs, n_units, issue, CASE WHEN issue IS NULL THEN best.x END AS execute_id, CASE WHEN issue IS NULL THEN best.y END AS control_id FROM r""")
def conflict_rebinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conflicts, their lines as assignments: bound by the ids of two lines, or by the order alone where one unit has a pair."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    functions = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("fn_id"), F.col("l_orderkey").cast("string").alias("source_id"), F.concat(F.lit("u"), F.col("l_suppkey") % 3).alias("unit"),
        F.when(F.col("l_returnflag") == "R", "control").when(F.col("l_returnflag") == "A", "execute").otherwise("agree").alias("role"), F.lit("duty").alias("norm_type"), F.when(F.col("l_linestatus") == "O", "x").otherwise("").alias("scope"), F.lit(True).alias("owner_known"), "l_partkey",
    )
    ids = functions.groupBy(F.col("source_id").cast("long").alias("finding_id")).agg(F.slice(F.array_sort(F.collect_list(F.col("fn_id").cast("long"))), 1, 2).alias("ids"))
    ids = ids.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id")), "finding_id")
    findings = ids.select("finding_id", F.when(F.col("finding_id") % 2 == 0, F.col("ids")).alias("function_ids"), F.array("finding_id").alias("source_ids"))
    return S.rebind_conflicts(findings, functions, -F.abs(F.col("a_l_partkey") - F.col("b_l_partkey")))


@query("SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value::DECIMAL(18, 4)), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def streamed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day buckets of the events as a stream of several files, from the log of given and retracted buckets."""
    landing = scratch_path(spark, "landing")
    zone = spark.conf.get("spark.sql.session.timeZone")
    clock = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)  # the table's clock time as that of UTC
    events = table(spark, sf_dir, "events").select("event_id", clock.alias("ts"), "event_type", "value")
    events.repartitionByRange(6, "ts").write.parquet(landing)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    log = streams.roll(spark, stream, "60 days")
    return streams.net(log, ["day", "event_type"]).select(F.col("day").cast("string").alias("day"), "event_type", "n", F.round("total", 4).cast("double").alias("total"))
