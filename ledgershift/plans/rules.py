"""The rules on texts, periods, measures, values, reviews and reports, over columns of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as Me
from ..functions import text as T
from ..functions.periods import is_full_period
from ..operators import explore as X
from ..operators import reports as R
from ..operators import review as V
from ..operators import runs as U
from ..operators import scoring as S
from ..sources import pages as P
from .base import query, table

_LINES = r"l AS (SELECT doc_id, k, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "line")).withColumn("k", F.col("k") + 1)


def _list(*values: str):
    return F.array(*(F.lit(v) for v in values))


@query(rf"""WITH {_LINES} SELECT doc_id, sum(CASE WHEN n <> '' THEN len(string_split(n, ' ')) END)::BIGINT AS words, sum(length(n))::BIGINT AS chars FROM
    (SELECT doc_id, array_to_string(regexp_extract_all(translate(lower(line), 'ё', 'е'), '[а-яa-z0-9]+'), ' ') AS n FROM l) GROUP BY doc_id""")
def line_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of every line of documents: its words and letters."""
    n = T.norm(F.col("line"))
    rows = _lines(spark, sf_dir).select("doc_id", n.alias("n"))
    return rows.groupBy("doc_id").agg(F.sum(F.when(F.col("n") != "", F.size(F.split("n", " ")))).cast("long").alias("words"), F.sum(F.length("n")).cast("long").alias("chars"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(rf"""WITH {_LINES}, w AS (SELECT DISTINCT doc_id, k, unnest(regexp_extract_all(translate(lower(line), 'ё', 'е'), '[а-яa-z0-9]+')) AS w FROM l)
    SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_different FROM w WHERE length(w) > 2 AND w NOT IN ({_STOP}) AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY doc_id""")
def line_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token sets of every line of documents, counted by document; words of other alphabets have no endings to lose."""
    rows = _lines(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("line"))).alias("w"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("w").alias("n_different"))


_VERBS = ("обязан хранить", "имеет право запрашивать", "не имеет права согласовывать", "проводит проверку", "обсуждение и согласование", "организует учет", "участвует в приемке", "утверждает план", "не осуществляет контроль", "вправе консультировать")
_NORMS = ("duty", "right", "prohibition", "duty", "duty", "duty", "duty", "duty", "prohibition", "right")
_ROLES = ("execute", "execute", "execute", "control", "agree", "coordinate", "participate", "approve", "execute", "execute")


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"SELECT o_orderkey, ({_sql_list(_NORMS)})[o_orderkey % 10 + 1] AS norm_type, ({_sql_list(_ROLES)})[o_orderkey % 10 + 1] AS role, o_orderkey % 3 = 1 AS generic FROM orders")
def duty_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm, role and generality of clauses on orders, each with one of ten predicates."""
    verb = F.get(_list(*_VERBS), (F.col("o_orderkey") % 10).cast("int"))
    tail = F.get(_list("документы склада", "прочих поручений руководства", "заявки филиала"), (F.col("o_orderkey") % 3).cast("int"))
    text = F.concat(F.lit("5.1. "), verb, F.lit(" "), tail, F.lit(" "), F.regexp_replace("o_orderpriority", r"^\d-", ""))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", T.norm_type(F.col("text"), F.lit("duty")).alias("norm_type"), T.role(F.col("text")).alias("role"), T.is_generic(F.col("text")).alias("generic"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'обеспечивает учет ' || l_partkey || ' | проводит сверку ' || l_suppkey || ' | готовит отчет' ELSE 'ведет реестр ' || l_partkey || ' | хранит договоры' END AS parts,
    2 + CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS n FROM lineitem""")
def duty_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinated predicates of clauses on order lines, apart."""
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("обеспечивает учет "), part, F.lit(", проводит сверку "), supplier, F.lit(" и готовит отчет"))).otherwise(F.concat(F.lit("ведет реестр "), part, F.lit("; хранит договоры;")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.split_actions(text).alias("p"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("p", " | ").alias("parts"), F.size("p").alias("n"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 4 AS k FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN 'month' WHEN 1 THEN 'quarter' WHEN 2 THEN 'year' ELSE 'none' END AS whole FROM d""")
def whole_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calendar period an interval around an order's date is; one day more is none."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    start = F.when(k == 0, F.trunc(d, "month")).when(k == 1, F.trunc(d, "quarter")).otherwise(F.trunc(d, "year"))
    end = F.when(k == 0, F.last_day(d)).when(k == 1, F.last_day(F.add_months(F.trunc(d, "quarter"), 2))).when(k == 2, F.last_day(F.add_months(F.trunc(d, "year"), 11))).otherwise(F.date_add(F.last_day(F.add_months(F.trunc(d, "year"), 11)), 1))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("s"), end.alias("e"))
    found = F.lit("none")
    for kind in ("year", "quarter", "month"):
        found = F.when(is_full_period(F.col("s"), F.col("e"), kind), kind).otherwise(found)
    return rows.select("o_orderkey", found.alias("whole"))


@query("""SELECT p_partkey, ['дни', 'шт.', 'чел.', 'FTE', 'баллы', p_type][p_partkey % 6 + 1] AS unit, ['ДНМ', 'BVA', p_brand][p_partkey % 3 + 1] AS scope,
    CASE WHEN p_size > 26 THEN chr((64 + (p_size - 1) // 26)::INTEGER) ELSE '' END || chr((65 + (p_size - 1) % 26)::INTEGER) || (p_partkey + 1) AS cell FROM part""")
def measure_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, scopes and cell addresses, written by parts in one of their spellings."""
    k = F.col("p_partkey")
    unit = F.get(F.array(*(F.lit(x) for x in ("дней", "Ед.", "человек", "fte", "баллов")), F.concat(F.lit(" "), F.col("p_type"))), (k % 6).cast("int"))
    scope = F.get(F.array(F.lit("dnm"), F.lit(" БВА"), F.col("p_brand")), (k % 3).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", Me.unit_of_measure(unit).alias("unit"), Me.scope_name(scope).alias("scope"), Me.cell_address(F.col("p_size"), k + 1).alias("cell"))


@query("""SELECT p_partkey, p_partkey % 3 <> 1 AS grounded, p_partkey % 4 <> 2 AS fine, p_partkey % 5 <> 3 AS evidenced FROM part""")
def wording_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether numbers are grounded, no cause is claimed, and a scope stands in the text, of sentences on parts."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    said = F.concat(F.lit("размер "), F.when(k % 3 == 1, F.lit("7777")).otherwise(size), F.when(k % 4 == 2, F.lit(" привело к росту")).otherwise(F.lit(" в отчете")))
    facts = F.concat(F.lit("p_size "), size, F.lit(".001, p_retailprice "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    text = F.concat(F.lit("Отчет "), F.when(k % 5 == 3, F.lit("иного отдела")).otherwise(F.lit("DKKM (план)")), F.lit(" за год"))
    return table(spark, sf_dir, "part").select("p_partkey", Me.numbers_grounded(said, facts).alias("grounded"), T.plain_text_ok(said).alias("fine"), Me.scope_evidenced(F.lit("ДККМ"), text, F.lit("")).alias("evidenced"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'report_delay_days' WHEN 1 THEN 'qa_score audits_done' ELSE '' END AS metrics FROM customer")
def metric_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.get(_list("сдаёт отчёт в срок", "проверки качества", "хранит сырьё"), (F.col("c_custkey") % 3).cast("int")), F.lit(" "), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(Me.suggested_metrics(text), " ").alias("metrics"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.39 ELSE round(greatest(0, least(0.45 + 0.38 * (1 - p_retailprice / 3000) + 0.08 + 0.05 * 0.5 + 0.03, CASE WHEN p_retailprice / 3000 >= 0.55 OR p_partkey % 3 = 0 THEN 0.69 ELSE 0.99 END)), 2) END AS loss,
    round(least(0.10 + 0.65 * (p_retailprice / 3000) + 0.10 + 0.10 + 0.04, CASE WHEN p_partkey % 2 = 0 THEN 0.89 ELSE 0.99 END), 2) AS match,
    round(least(0.20 + 0.50 * (p_retailprice / 3000) + 0.15 + 0.10, 0.89), 2) AS conflict FROM part""")
def finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of findings whose signals are the prices of parts."""
    k, x, yes = F.col("p_partkey"), F.col("p_retailprice") / 3000, F.lit(True)
    no_warning = k % 3 != 0
    loss = S.loss_score(x, k % 5 != 0, F.lit(0.5), yes, yes, no_warning, F.lit(False), F.lit(False), F.lit(False))
    match = S.match_score(x, F.lit(1.0), yes, yes, k % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", loss.alias("loss"), match.alias("match"), S.conflict_score(x, yes, F.lit(""), F.lit("")).alias("conflict"))


@query("""WITH v AS (SELECT l_orderkey * 4 + l_linenumber % 4 AS id, l_quantity, l_tax, l_shipdate, l_returnflag, l_linestatus FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM v)
    SELECT DISTINCT id::VARCHAR AS id, CASE WHEN n > 1 THEN 'repeated_id' WHEN l_tax = 0 THEN 'source' WHEN l_quantity > 45 THEN 'number' WHEN l_returnflag = 'N' THEN 'scope_or_metric' WHEN l_linestatus = 'O' THEN 'period' END AS reason FROM n
    WHERE n > 1 OR l_tax = 0 OR l_quantity > 45 OR l_returnflag = 'N' OR l_linestatus = 'O'""")
def run_value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as values of a run, each with what a run may not use."""
    d = F.col("l_shipdate").cast("date")
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4).cast("string").alias("id"), F.lit("m").alias("metric"), F.when(F.col("l_returnflag") == "N", " ").otherwise("s").alias("scope"), d.alias("start"),
        F.when(F.col("l_linestatus") == "O", F.date_sub(d, 1)).otherwise(d).alias("end"), F.when(F.col("l_quantity") > 45, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("value"), F.lit("f").alias("file"),
        F.when(F.col("l_tax") == 0, "").otherwise("q").alias("quote"), F.lit("A1").alias("cell"),
    )
    return U.invalid_values(rows)


@query("""SELECT event_id::VARCHAR AS event_id, CASE WHEN value < 5 THEN 'date' ELSE 'mechanism' END AS reason FROM events WHERE value < 5 OR (event_type = 'purchase' AND json_extract_string(props, '$.k')::BIGINT % 2 = 0)""")
def run_event_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a run: undated ones, and confirmed ones without words."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("value") >= 5, F.to_date("ts")).alias("effective"), F.when(k % 2 == 0, " ").otherwise("m").alias("mechanism"), (F.col("event_type") == "purchase").alias("confirmed"), F.array(F.lit("q")).alias("quotes"))
    return U.invalid_events(rows)


@query("""WITH v AS (SELECT event_type AS metric, 'u' || user_id % 7 AS scope, CASE WHEN value < 20 THEN 'month' ELSE 'year' END AS granularity, CASE user_id % 2 WHEN 0 THEN 'шт.' ELSE 'дни' END AS unit FROM events),
    c AS (SELECT granularity, unit FROM v WHERE metric = 'click' AND scope = 'u3' GROUP BY ALL ORDER BY count(*) DESC, granularity, unit LIMIT 1)
    SELECT scope, granularity, unit, count(*) AS n FROM v JOIN c USING (granularity, unit) WHERE metric = 'click' GROUP BY ALL""")
def chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that one chart holds with the clicks of one group of users: their most frequent granularity and unit."""
    user = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.concat(F.lit("u"), (user % 7).cast("string")).alias("scope"), F.when(F.col("value") < 20, "month").otherwise("year").alias("granularity"), F.when(user % 2 == 0, "шт. ").otherwise("дни").alias("unit"))
    return U.comparable_series(rows, "click", "u3").select("scope", "granularity", "unit", "n")


@query("""SELECT 'm' || user_id AS metric, bool_and(value > 1) OR user_id % 9 = 0 AS allowed FROM events GROUP BY user_id""")
def uncatalogued_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as metrics: in the catalogue, or every value confirmed."""
    events = table(spark, sf_dir, "events")
    metric = F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("metric")
    return U.allowed_metrics(events.select(metric, (F.col("value") > 1).alias("confirmed")), events.where("user_id % 9 = 0").select(metric.alias("code")).distinct())


@query("SELECT row_number() OVER (ORDER BY min(event_id), w) AS place, w AS warning FROM (SELECT event_id, event_type || ' ' || user_id AS w FROM events) GROUP BY w")
def run_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each warning once, in the order in which it was first seen."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("warning"))
    return U.distinct_warnings(rows, False).select(F.col("place").cast("long").alias("place"), "warning")


@query("""WITH r AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') SELECT l_orderkey AS recommendation_id, d AS decision, CASE WHEN d = 'maybe' THEN 'decision' WHEN o_orderkey IS NULL THEN 'recommendation' END AS error
    FROM (SELECT DISTINCT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'discuss' ELSE 'maybe' END AS d FROM lineitem) LEFT JOIN r ON o_orderkey = l_orderkey""")
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of order lines on orders: one of three, on what exists."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("recommendation_id"))
    said = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("recommendation_id"), F.get(_list("accept", "reject", "discuss", "maybe"), F.col("l_linenumber") % 4).alias("decision")).distinct()
    return U.save_decisions(known, said)


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'keys' WHEN k % 3 = 0 THEN 'not_json' END AS error, CASE WHEN event_type <> 'error' AND k % 3 <> 0 THEN k END AS k FROM (SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events as answers in a code fence: read strictly, refused with other keys or a constant that is no JSON."""
    k = F.get_json_object("props", "$.k")
    error = F.col("event_type") == "error"
    answer = F.when(error, F.concat(F.lit('{"k": 1, "more": '), k, F.lit("}"))).when(k.cast("long") % 3 == 0, F.lit('{"k": NaN}')).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    rows = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return V.decoded(rows, "answer", "k long", ("k",)).select("event_id", "error", F.col("value.k").alias("k"))


@query("""WITH c AS (SELECT o_custkey AS run, o_orderkey FROM orders), r AS (SELECT o_custkey AS run, l_orderkey, CASE l_returnflag WHEN 'R' THEN 'reject' ELSE 'approve' END AS verdict, CASE WHEN l_linestatus = 'O' AND l_discount > 0.08 THEN ' ' ELSE 'so' END AS reason FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1),
    b AS (SELECT c.run, c.o_orderkey, count(verdict) AS n, coalesce(bool_and(trim(reason) <> ''), false) AS ok, min(verdict) AS v FROM c LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY ALL),
    w AS (SELECT run, bool_and(n = 1 AND ok) AS whole, count(*) FILTER (v = 'approve') AS a, count(*) FILTER (v = 'reject') AS j FROM b GROUP BY run)
    SELECT run, CASE WHEN whole THEN 'completed' ELSE 'failed' END AS status, CASE WHEN whole THEN a ELSE 0 END AS approved, CASE WHEN whole THEN j ELSE 0 END AS rejected FROM w""")
def verdict_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as runs, their orders as claims, first lines as verdicts: all or nothing."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("claim_id"))
    said = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").join(orders, F.col("l_orderkey") == F.col("claim_id"))
    blank = (F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.08)
    said = said.select("run", "claim_id", F.when(F.col("l_returnflag") == "R", "reject").otherwise("approve").alias("verdict"), F.when(blank, " ").otherwise("so").alias("reason"))
    return V.check_verdicts(orders, said).select("run", "status", F.col("approved").cast("long").alias("approved"), F.col("rejected").cast("long").alias("rejected"))


@query("""SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS missing, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS extra,
    (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS repeated, false AS exact""")
def exact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether order lines name each order once."""
    return V.exact_index(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id")


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS r, 's' || l_suppkey AS id FROM lineitem UNION SELECT l_orderkey, 'p' || l_partkey FROM lineitem) SELECT DISTINCT a.id AS source_id, b.id AS related_id FROM i a JOIN i b ON a.r = b.r AND a.id <> b.id""")
def source_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts of one order are related sources."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_ord"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("frag_id"), F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("contexts"))
    return V.related_sources(rows)


@query(rf"""WITH {_LINES}, c AS (SELECT doc_id, k FROM l WHERE regexp_matches(line, '[0-9]')) SELECT DISTINCT l.doc_id || ':' || l.k AS source_id FROM l JOIN c ON c.doc_id = l.doc_id AND abs(l.k - c.k) <= 2 WHERE NOT regexp_matches(line, '[0-9]')""")
def verification_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within two of a line that holds a digit, and hold none themselves."""
    rows = _lines(spark, sf_dir).select(F.col("doc_id").alias("document"), F.col("k").alias("line_no"), F.concat_ws(":", "doc_id", "k").alias("frag_id"), "line")
    cited = rows.where(F.col("line").rlike("[0-9]")).select(F.col("frag_id").alias("source_id"))
    none = spark.createDataFrame([], "frag_id string, contexts array<string>")
    return V.verification_context(cited, rows.drop("line"), none)


@query("""WITH f AS (SELECT event_type AS kind, round(least(value / 50, 0.99), 2) AS score FROM events WHERE event_type IN ('click', 'error')) SELECT kind, count(*) FILTER (score >= 0.4) AS shown, count(*) FILTER (score < 0.4) AS hidden FROM f GROUP BY kind""")
def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of two kinds that are shown, and the weak ones that are counted only."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.round(F.least(F.col("value") / 50, F.lit(0.99)), 2).alias("score"))
    shown, hidden = R.filter_findings(rows, ("click", "error"))
    return shown.groupBy("kind").agg(F.count("*").alias("shown")).join(hidden, "kind", "full").select("kind", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("hidden", F.lit(0)).alias("hidden"))


@query("""WITH f AS (SELECT ['loss', 'duplicate', 'conflict', 'other'][event_id % 4 + 1] AS kind, value / 50 AS score FROM events) SELECT name, n AS value FROM (SELECT kind AS name, count(*) AS n FROM f WHERE kind <> 'other' GROUP BY kind UNION ALL SELECT 'strong', count(*) FROM f WHERE score >= 0.7)""")
def overview_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.get(_list("loss", "duplicate", "conflict", "other"), (F.col("event_id") % 4).cast("int")).alias("kind"), (F.col("value") / 50).alias("score"))
    return X.executive_overview(rows)


@query("""SELECT doc_id::VARCHAR AS key, part::INTEGER AS part, parts::INTEGER AS parts, md5(v[(part - 1) * 15000 + 1:part * 15000]) AS value_md5 FROM (SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS v FROM
    (SELECT doc_id, regexp_replace('=' || coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS t FROM documents)), LATERAL (SELECT ceil(greatest(length(v), 1) / 15000.0)::INTEGER AS parts), unnest(range(1, parts + 1)) AS t(part)""")
def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that look like formulas as cells of a sheet, whole, in parts of a cell's size."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("="), F.coalesce("text", F.lit(""))).alias("cell_text"))
    return R.sheet(rows, "S", "doc_id", ["cell_text"]).select("key", "part", "parts", F.md5("value").alias("value_md5"))


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS t FROM documents)
    SELECT doc_id, md5(regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\`*_\[\]#|!])', '\\\1', 'g')) AS escaped_md5 FROM d""")
def markdown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, safe inside a Markdown report."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.markdown_safe(F.coalesce("text", F.lit("")))).alias("escaped_md5"))


@query("SELECT name, value FROM (SELECT count(*) AS requests, count(*) FILTER (o_orderstatus = 'F') AS completed, sum(o_custkey)::BIGINT AS sent, coalesce(sum(o_custkey) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS covered, coalesce(sum(o_orderkey) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS tokens_in, 0::BIGINT AS tokens_out, count(*) FILTER (o_orderstatus = 'P') AS usage_unknown FROM orders) UNPIVOT (value FOR name IN (requests, completed, sent, covered, tokens_in, tokens_out, usage_unknown))")
def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: what was sent, done, and reported to be used."""
    done = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    rows = table(spark, sf_dir, "orders").select(F.lit("r").alias("run"), done.alias("state"), F.col("o_custkey").alias("sources"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("tokens_in"), F.lit(0).cast("long").alias("tokens_out"))
    return V.coverage_overview(rows)


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n\s*\n')) AS b FROM documents) SELECT doc_id AS document, count(*) AS blocks, sum(length(trim(regexp_replace(b, '\s+', ' ', 'g'))))::BIGINT AS chars FROM p WHERE trim(regexp_replace(b, '\s+', ' ', 'g')) <> '' GROUP BY doc_id""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, cut into blocks at blank lines."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document"), F.lit(1).alias("page_no"), "text", F.lit(None).cast("string").alias("layout"))
    return P.page_blocks(rows).groupBy("document").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("""WITH e AS (SELECT user_id, event_type, list_sort(list(DISTINCT json_extract_string(props, '$.k'))) AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
    SELECT a.user_id, len(list_intersect(a.t, b.t))::INTEGER AS shared, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS containment FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'""")
def set_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the keys of a user's clicks and views are as sets."""
    key = F.get_json_object("props", "$.k")
    own = lambda kind: F.array_sort(F.collect_set(F.when(F.col("event_type") == kind, key)))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(own("click").alias("a"), own("view").alias("b")).where("size(a) > 0 and size(b) > 0")
    a, b = F.col("a"), F.col("b")
    return rows.select("user_id", F.size(F.array_intersect(a, b)).alias("shared"), F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.containment(a, b), 6).alias("containment"))


@query("""WITH a AS (SELECT DISTINCT o_custkey, o_orderpriority AS w FROM orders), n AS (SELECT w, row_number() OVER (ORDER BY w) AS place FROM (SELECT DISTINCT w FROM a))
    SELECT w AS unit, CASE WHEN length(w) <= 8 THEN w ELSE 'П' || place END AS label FROM n""")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short labels of the order priorities, as columns of a matrix."""
    names = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("unit")).distinct()
    return R.unit_labels(names.withColumn("ord", F.col("unit")))

