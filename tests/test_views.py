"""Confirmations, charts, sources and limits on small tables: nulls, ties, nothing."""

from __future__ import annotations

import datetime as dt

from ledgershift.operators import explore, ingest, review, runs

QUEUE = "id string, code string, scope string, start date, end date, value double, quote string, label string, reason string"
SAID = "ord long, id string, code string, scope string, start date, end date, granularity string, value double, unit string"
YEAR = (dt.date(2023, 1, 1), dt.date(2023, 12, 31))


def test_confirmations(spark):
    queue = spark.createDataFrame(
        [("a", "done", "s", *YEAR, 5.0, "done 1,234", "Done", "number"), ("b", "done", "s", *YEAR, 7.0, "7 done", "Done", "conflict"), ("c", "done", "s", *YEAR, 8.0, "8 done", "Done", "conflict"), ("d", "custom_x", None, None, None, 9.0, "9", "", "unknown_metric")], QUEUE
    )
    known = spark.createDataFrame([("done", "n")], "code string, unit string")
    said = [
        (1, "a", "done", "s", *YEAR, "year", None, None),  # the proposed 5 is not in the quote
        (2, "a", "done", "s", *YEAR, "year", 1234.0, None), (3, "a", "done", "s", *YEAR, "year", 1234.0, None), (4, "c", "done", "s", *YEAR, "year", None, None), (5, "b", "done", "s", *YEAR, "year", None, None),
        (6, "d", "custom_x", "s", *YEAR, "year", None, "n"), (7, None, "done", "s", *YEAR, "year", 1.0, None), (8, "b", "done", "s", YEAR[0], None, "year", None, None),
    ]
    out = ingest.confirmations(queue, spark.createDataFrame(said, SAID), known)
    assert {r.ord: r.state for r in out.collect()} == {1: "number", 2: "confirmed", 3: "resolved", 4: "confirmed", 5: "resolved", 6: "custom_metric", 7: "unknown_item", 8: "resolved"}
    assert [r.id for r in ingest.still_queued(queue, out.where("state = 'confirmed'")).collect()] == ["d"]
    # an item of the same key that is no conflict stays
    assert sorted(r.id for r in ingest.still_queued(queue, out.where("ord = 4")).collect()) == ["a", "d"]
    assert ingest.confirmations(queue.limit(0), spark.createDataFrame([], SAID), known).count() == 0


def test_default_chart(spark):
    kind = "metric string, scope string, granularity string, unit string, start string, value double"
    rows = [("b", "s", "year", "n", "", 1.0), ("b", "s", "year", "m", "", 1.0), ("b", "s", "month", None, "", 1.0), ("b", "s", "month", " ", "", 1.0), ("a", "s", "week", "n", "", 1.0), ("report_delay_days", "s", "year", "d", "", 1.0)]
    values = spark.createDataFrame(rows, kind)
    assert [tuple(r) for r in runs.default_chart(values, "b").collect()] == [("report_delay_days", "year", "d")]
    assert [tuple(r) for r in runs.default_chart(values, "b", "none").collect()] == [("b", "month", "")]
    assert [tuple(r) for r in runs.default_chart(values, None, "none").collect()] == [("a", "week", "n")]
    assert runs.default_chart(values.limit(0)).count() == 0
    shown = runs.chart_rows(values, runs.default_chart(values, "b", "none"), spark.createDataFrame([("s",), ("s",)], "scope string"))
    assert [(r.scope, r.role) for r in shown.collect()] == [("s", "control")] * 2


def test_sources_in_order(spark):
    some = lambda *rows: spark.createDataFrame(rows, "ord long, id string, text string")
    out = explore.collected_sources([some((1, "b", "b1"), (2, "a", "a1"), (3, None, "x")), some((0, "c", "c1"), (1, "b", "b2"))], "id", "text")
    assert sorted((r.place, r.id, r.text) for r in out.collect()) == [(1, "b", "b2"), (2, "a", "a1"), (3, "c", "c1")]


def test_answers_keep_their_limits(spark):
    rows = [("r", "event", str(i % 14), i) for i in range(20)] + [("r", "risk", None, 0), ("r", "risk", None, 1), ("r", "tale", "x", 0)]
    out = review.within_answer(spark.createDataFrame(rows, "run string, kind string, signature string, ord long")).groupBy("kind", "state").count()
    assert {(r["kind"], r["state"]): r["count"] for r in out.collect()} == {("event", "taken"): 12, ("event", "over_limit"): 2, ("event", "repeated"): 6, ("risk", "taken"): 1, ("risk", "repeated"): 1, ("tale", "unknown_kind"): 1}


def test_answers_with_equal_places_keep_their_limits(spark):
    """Two first occurrences of one ord stand one after the other at the limit."""
    rows = [("r", "event", str(i), i // 2) for i in range(5, 19)] + [("r", "event", "17", 8)]
    out = review.within_answer(spark.createDataFrame(rows, "run string, kind string, signature string, ord long"))
    assert {r["state"]: r["count"] for r in out.groupBy("state").count().collect()} == {"taken": 12, "over_limit": 2, "repeated": 1}
