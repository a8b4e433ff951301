"""The review chain as tables: strict decoding of model answers, rules for risks and drafts, payloads, verdicts, coverage.

No model is called here. Whatever an answer says is checked against the sources that were sent; a rule that is broken
rejects the item with its reason, and an incomplete set of verdicts approves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import numbers_grounded
from ..functions.numbers import clamp_score, finite
from ..functions.text import plain_text_ok
from ..session import materialize
from .claims import first_reason

# Limits of texts, quotes and lists in answers, of payloads in characters, and of claims in one request.
TITLE, EXPLANATION, ADVICE, REASON = 500, 12_000, 5_000, 1_500
QUOTE, QUOTE_MOST, SOURCES_MOST = 12, 300, 20
FULL_CATALOG, PAYLOAD, CLAIMS = 600_000, 160_000, 45
COMPARISONS, RISKS, ATTRIBUTIONS, EVENTS = 30, 15, 8, 12
REPORTED_CAP = 0.89
#: Sources that are sent with another one at once, and pairs that one partition compares.
RELATED_LIST, RELATED_PAIRS = 1000, 1_000_000
#: Items of each kind that an answer may bring.
ANSWERS = {"comparison": COMPARISONS, "risk": RISKS, "attribution": ATTRIBUTIONS, "event": EVENTS}
# Kinds of risks and of comparisons, words that hedge a title, states of an interface and what a user may see of them.
RISK_KINDS, COMPARISON_KINDS = ("loss", "duplicate", "conflict"), ("retained", "changed", "moved", "added", "possibly_lost")
HEDGED = "(?iU)возможн|потенциальн|кандидат"
SAFE_ERRORS = (("timeout", "the service did not answer in time"), ("401", "the key was refused"), ("403", "the key was refused"), ("429", "the limit of requests is reached"), ("5", "the service failed"))


def unfenced(text: Column) -> Column:
    """An answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?is)\A```(?:json)?\s*", ""), r"\s*```\z", ""))


def decoded(answers: DataFrame, text: str, schema: str, keys: tuple[str, ...], most: int = 250_000) -> DataFrame:
    """answers with `value` (struct of schema) and `error`: too long, not JSON (bare constants such as NaN are not), or other keys than asked."""
    plain = unfenced(F.col(text))
    found = F.json_object_keys(plain)
    error = first_reason(too_long=F.length(text) > most, not_json=found.isNull(), keys=F.array_sort(found) != F.array(*(F.lit(k) for k in sorted(keys))))
    value = F.from_json(plain, schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    return answers.withColumns({"error": error, "value": F.when(error.isNull(), value)})


def encoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows' columns as one JSON object a row, nulls kept; error where a number is not finite."""
    kinds = dict(rows.dtypes)
    broken = [F.coalesce(~finite(F.col(c)) & F.col(c).isNotNull(), F.lit(False)) for c in columns if kinds[c] in ("double", "float")]
    bad = F.lit(False)
    for x in broken:
        bad = bad | x
    return rows.withColumns({"error": F.when(bad, "not_finite"), "json": F.when(~bad, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))})


def _texts_ok() -> Column:
    ok = F.lit(True)
    for name, most in (("title", TITLE), ("explanation", EXPLANATION), ("recommendation", ADVICE)):
        ok = ok & F.coalesce((F.trim(name) != "") & (F.length(name) <= most), F.lit(False))
    return ok


def check_risks(risks: DataFrame, sources: DataFrame, prohibitions: DataFrame) -> DataFrame:
    """risk_id, reason, title, score of risks(risk_id, kind, title, explanation, recommendation, confidence, evidence).

    evidence: array of (source_id, quote); sources: source_id, period, text; prohibitions: source_id of lines that only
    forbid. A loss needs a side before that is not all prohibitions, and one after; others two sources after that are
    none. Valid ones get a hedged title and a score of at most the high band.
    """
    item = risks.withColumn("ok_texts", _texts_ok()).select("*", F.explode_outer("evidence").alias("e")).select("*", F.col("e.source_id").alias("source_id"), F.col("e.quote").alias("quote"))
    item = item.join(sources, "source_id", "left").join(prohibitions.select("source_id", F.lit(True).alias("forbids")).distinct(), "source_id", "left")
    forbids = F.coalesce("forbids", F.lit(False))
    quoted = F.coalesce((F.length(F.trim("quote")) >= QUOTE) & F.contains("text", "quote"), F.lit(False))
    before, after = F.col("period") == "before", F.col("period") == "after"
    by = item.groupBy("risk_id").agg(
        F.first("kind").alias("kind"), F.first("title").alias("title"), F.first("confidence").alias("confidence"), F.bool_and("ok_texts").alias("ok_texts"), F.count_distinct("source_id").alias("n"),
        F.bool_or(F.col("period").isNull()).alias("unknown"), F.bool_and(quoted).alias("quoted"), F.count_distinct(F.when(before, F.col("source_id"))).alias("n_before"),
        F.count_distinct(F.when(after, F.col("source_id"))).alias("n_after"), F.count_distinct(F.when(before & ~forbids, F.col("source_id"))).alias("may_before"), F.count_distinct(F.when(after & ~forbids, F.col("source_id"))).alias("may_after"),
    )
    loss = F.col("kind") == "loss"
    reason = first_reason(
        kind=~F.coalesce(F.col("kind").isin(*RISK_KINDS), F.lit(False)), texts=~F.col("ok_texts"), confidence=~F.coalesce(finite(F.col("confidence")) & F.col("confidence").between(0, 1), F.lit(False)),
        sources=~F.col("n").between(1, SOURCES_MOST), unknown_source=F.col("unknown"), quote=~F.col("quoted"), one_sided_loss=loss & ((F.col("n_before") == 0) | (F.col("n_after") == 0)),
        only_prohibitions=loss & (F.col("may_before") == 0), single_source=~loss & (F.col("n_after") < 2), prohibitions=~loss & (F.col("may_after") < 2),
    )
    title = F.when(F.col("title").rlike(HEDGED), F.trim("title")).otherwise(F.concat(F.lit("Возможный риск: "), F.trim("title")))
    return by.select("risk_id", F.coalesce(reason, F.lit("accepted")).alias("reason"), F.when(reason.isNull(), title).alias("title"), F.when(reason.isNull(), clamp_score(F.col("confidence"), REPORTED_CAP)).alias("score"))


def within_answer(items: DataFrame, limits: dict[str, int] = ANSWERS) -> DataFrame:
    """items(run, kind, signature, ord) with `state`: taken, repeated (its signature came before), over_limit, unknown_kind.

    Only first occurrences count towards a kind's limit, one by one: those of one ord go by signature.
    """
    most = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("kind")]
    rows = items.withColumn("_nth", F.row_number().over(Window.partitionBy("run", "kind", "signature").orderBy("ord")))
    before = Window.partitionBy("run", "kind").orderBy("ord", "signature", "_nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_place", F.sum(F.when(F.col("_nth") == 1, 1)).over(before))
    state = F.when(most.isNull(), "unknown_kind").when(F.col("_nth") > 1, "repeated").when(F.col("_place") > most, "over_limit").otherwise("taken")
    return rows.withColumn("state", state).drop("_nth", "_place")


def reason_counts(checked: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n of rejected items."""
    return checked.where(F.col(reason) != "accepted").groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("n"))


def check_verdicts(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """run, status, approved, rejected: all or nothing. reviews(run, claim_id, verdict, reason) must name each claim(run, claim_id) once."""
    fine = F.coalesce(F.col("verdict").isin("approve", "reject") & (F.trim("reason") != "") & (F.length("reason") <= REASON), F.lit(False))
    both = claims.select("run", "claim_id", F.lit(True).alias("asked")).join(reviews, ["run", "claim_id"], "full")
    by = both.groupBy("run", "claim_id").agg(F.count("verdict").alias("n"), F.coalesce(F.bool_and(fine), F.lit(False)).alias("ok"), F.bool_or(F.col("asked")).alias("asked"), F.first("verdict").alias("verdict"))
    whole = (F.col("n") == 1) & F.col("ok") & F.coalesce("asked", F.lit(False))
    out = by.groupBy("run").agg(F.bool_and(whole).alias("whole"), F.count_if(F.col("verdict") == "approve").alias("a"), F.count_if(F.col("verdict") == "reject").alias("r"))
    return out.select("run", F.when(F.col("whole"), "completed").otherwise("failed").alias("status"), F.when(F.col("whole"), F.col("a")).otherwise(0).alias("approved"), F.when(F.col("whole"), F.col("r")).otherwise(0).alias("rejected"))


def exact_index(records: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """missing, extra, repeated, exact: whether records have each expected key once and no other."""
    n = records.groupBy(key).agg(F.count("*").alias("n")).join(expected.select(key, F.lit(True).alias("asked")).distinct(), key, "full")
    out = n.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("asked").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated"))
    return out.withColumn("exact", (F.col("missing") + F.col("extra") + F.col("repeated")) == 0)


def transport_aliases(sources: DataFrame) -> DataFrame:
    """run, source_id, alias, document_id: short opaque names for a request; B0001, A0001 by period, D001 by first use."""
    by = Window.partitionBy("run", "period").orderBy("ord")
    first = sources.groupBy("run", "period", "document").agg(F.min("ord").alias("first"))
    docs = first.withColumn("document_id", F.format_string("D%03d", F.row_number().over(Window.partitionBy("run").orderBy("first", "period"))))
    name = F.concat(F.when(F.col("period") == "before", "B").otherwise("A"), F.lpad(F.row_number().over(by).cast("string"), 4, "0"))
    return sources.withColumn("alias", name).join(docs.drop("first"), ["run", "period", "document"]).select("run", "source_id", "alias", "document_id")


def _fill(groups: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    for rows in groups:
        used = int(rows.loc[rows["required"], "size"].sum())
        sent, over = [], used > budget
        for required, size in rows.sort_values("ord")[["required", "size"]].itertuples(index=False):
            fits = required or used + size <= budget
            used += 0 if required or not fits else int(size)
            sent.append(bool(fits) and not over)
        yield rows.sort_values("ord").assign(sent=sent, failed=over)[["run", "source_id", "sent", "failed"]]


def fill_payload(sources: DataFrame, budget: int = PAYLOAD) -> DataFrame:
    """run, source_id, sent, failed of sources(run, ord, source_id, required, size).

    Cited sources always go; others in order as long as they fit, whole, and are left out where they do not. A request
    whose cited sources alone are too long fails. One request is one group, bounded by the documents it compares.
    """
    rows = sources.select(F.col("run").cast("string").alias("run"), F.col("ord").cast("long").alias("ord"), F.col("source_id").cast("string").alias("source_id"), "required", F.col("size").cast("long").alias("size"))
    return rows.groupBy("run").applyInPandas(lambda g: next(_fill(iter([g]), budget)), "run string, source_id string, sent boolean, failed boolean")


def catalog_mode(sources: DataFrame, budget: int = FULL_CATALOG) -> DataFrame:
    """run, chars, mode: the whole catalogue in one request if it fits, else retrieved fragments."""
    by = sources.groupBy("run").agg(F.sum("size").alias("chars"))
    return by.withColumn("mode", F.when(F.col("chars") <= budget, "full_catalog").otherwise("retrieved_fragments"))


def bounded_batches(batches: DataFrame, budget: int) -> DataFrame:
    """batches(run, batch, ord, source_id, size) without the last sources of a batch that do not fit; no source is cut."""
    running = Window.partitionBy("run", "batch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumn("used", F.sum("size").over(running)).where(F.col("used") <= budget).drop("used")


def related_sources(members: DataFrame) -> DataFrame:
    """source_id, related_id: sources of one matrix row, and a source with its contexts. members: row_ord, frag_id, contexts.

    A pair is sent once, under its smaller source, with the others of its row in one list of up to RELATED_LIST (as JSON, which
    takes half the bytes of an array); each partition of sources then sees all repeats of its pairs. There are enough partitions for RELATED_PAIRS pairs each.
    """
    ids = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.concat(F.array("frag_id"), "contexts"))))))
    rows = materialize(members.where(F.col("row_ord").isNotNull()).groupBy("row_ord").agg(ids.alias("ids")).where(F.size("ids") > 1).select("ids"), "related-rows")
    n = F.size("ids").cast("long")
    spark, kind = members.sparkSession, rows.schema["ids"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0) // RELATED_PAIRS + 1)
    own = rows.select("ids", F.posexplode("ids").alias("at", "x")).where(F.col("at") + 1 < F.size("ids"))
    lists = own.select("ids", "x", F.explode(F.sequence(F.col("at") + 2, F.size("ids"), F.lit(RELATED_LIST))).alias("from"))
    lists = lists.select("x", F.to_json(F.slice("ids", F.col("from"), F.lit(RELATED_LIST))).alias("others")).repartition(int(parts), "x")
    pair = lists.select("x", F.explode(F.from_json("others", kind)).alias("y")).distinct().sortWithinPartitions("x", "y")
    ways = F.array(F.struct(F.col("x").alias("source_id"), F.col("y").alias("related_id")), F.struct(F.col("y").alias("source_id"), F.col("x").alias("related_id")))
    return pair.select(F.inline(ways))


def verification_context(cited: DataFrame, lines: DataFrame, members: DataFrame, reach: int = 2) -> DataFrame:
    """source_id of uncited context: lines within `reach` of a cited one in its document, and contexts of cited assignments."""
    at = lines.select("document", "line_no", F.col("frag_id").alias("source_id"))
    hit = at.join(cited.select("source_id").distinct(), "source_id").select("document", F.explode(F.sequence(F.col("line_no") - reach, F.col("line_no") + reach)).alias("line_no"))
    near = at.join(hit.distinct(), ["document", "line_no"]).select("source_id")
    context = members.select(F.col("frag_id").alias("source_id"), "contexts").join(cited.select("source_id").distinct(), "source_id").select(F.explode("contexts").alias("source_id"))
    return near.union(context).distinct().join(cited, "source_id", "left_anti")


def uncovered(sources: DataFrame, sent: DataFrame) -> DataFrame:
    """Sources that no request has held."""
    return sources.join(sent.select("source_id").distinct(), "source_id", "left_anti")


def check_drafts(drafts: DataFrame, attributions: DataFrame) -> DataFrame:
    """attribution_id, reason of drafts(attribution_id, claim, mechanism, alternatives, metric_ids, clause_ids) against attributions(attribution_id, facts, allowed_metrics, allowed_clauses)."""
    rows = drafts.join(attributions, "attribution_id", "left")
    every = F.concat(F.array("claim", "mechanism"), F.coalesce("alternatives", F.array().cast("array<string>")))
    subset = lambda ids, allowed: (F.size(ids) > 0) & (F.size(F.array_except(ids, allowed)) == 0)
    reason = first_reason(
        unknown=F.col("facts").isNull(), wording=~F.forall(every, lambda x: plain_text_ok(x)), alternatives=F.size("alternatives") < 1, numbers=~F.coalesce(F.forall(every, lambda x: numbers_grounded(x, F.col("facts"))), F.lit(False)),
        metrics=~F.coalesce(subset("metric_ids", "allowed_metrics"), F.lit(False)), clauses=~F.coalesce(subset("clause_ids", "allowed_clauses"), F.lit(False)),
    )
    return rows.select("attribution_id", F.coalesce(reason, F.lit("accepted")).alias("reason"))


def refined_recommendations(recommendations: DataFrame, answers: DataFrame) -> DataFrame:
    """recommendations(recommendation_id, action, risks, facts) with a model's risks as questions; its actions are never taken.

    An answer with a number in the action, unfit wording, or a number that the facts lack changes nothing.
    """
    said = answers.select("recommendation_id", F.col("action").alias("said"), F.col("risks").alias("more"))
    rows = recommendations.join(said, "recommendation_id", "left")
    fine = plain_text_ok(F.col("said")) & ~F.col("said").rlike(r"\d|%") & F.forall("more", lambda x: plain_text_ok(x) & numbers_grounded(x, F.col("facts")))
    questions = F.transform("more", lambda x: F.concat(F.lit("? "), x))
    return rows.withColumn("risks", F.when(F.coalesce(fine, F.lit(False)), F.array_distinct(F.concat("risks", questions))).otherwise(F.col("risks"))).drop("said", "more", "facts")


def check_mechanisms(proposals: DataFrame, events: DataFrame, codes: tuple[str, ...]) -> DataFrame:
    """event_id, reason of proposals(event_id, metric_codes, mechanism, quote) against events(event_id, quotes); accepted ones stay unconfirmed."""
    rows = proposals.join(events.select("event_id", "quotes"), "event_id", "left")
    known = F.array(*(F.lit(c) for c in codes))
    reason = first_reason(
        unknown=F.col("quotes").isNull(), wording=~plain_text_ok(F.col("mechanism")), quote=~F.coalesce((F.length(F.trim("quote")) >= QUOTE) & F.exists("quotes", lambda q: F.contains(q, F.col("quote"))), F.lit(False)),
        codes=~F.coalesce((F.size("metric_codes") > 0) & (F.size(F.array_except("metric_codes", known)) == 0), F.lit(False)),
    )
    return rows.select("event_id", F.coalesce(reason, F.lit("accepted")).alias("reason"))


def coverage_overview(requests: DataFrame) -> DataFrame:
    """name, value rows of requests(run, state, sources, tokens_in, tokens_out): what was sent, done, and reported to be used."""
    done = F.col("state") == "completed"
    one = requests.agg(
        F.count("*").alias("requests"), F.count_if(done).alias("completed"), F.coalesce(F.sum("sources"), F.lit(0)).alias("sent"), F.coalesce(F.sum(F.when(done, F.col("sources"))), F.lit(0)).alias("covered"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.count_if(F.col("tokens_in").isNull()).alias("usage_unknown"),
    )
    return one.unpivot([], one.columns, "name", "value")


def safe_error(status: Column) -> Column:
    """What a user may see of a failure, by its status; never the provider's own words."""
    out = F.when(F.lit(False), "")
    for start, shown in SAFE_ERRORS:
        out = out.when(status.startswith(start), shown)
    return out.otherwise("the step did not finish; local results are kept")
