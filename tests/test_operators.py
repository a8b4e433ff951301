"""Arithmetic and text contracts of the reference's operators on small fixtures."""

from __future__ import annotations

import datetime as dt
import difflib
import random

import pytest
from ledgershift.functions import numbers as N
from ledgershift.functions import periods as P
from ledgershift.functions import text as T
from ledgershift.operators import claims, compare, matching, registry, series
from ledgershift.sources import lines
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2022", ("2022-01-01", "2022-12-31", "year")), ("за 2023 год", ("2023-01-01", "2023-12-31", "year")), ("Q1 2023", ("2023-01-01", "2023-03-31", "quarter")),
        ("1 кв. 2023", ("2023-01-01", "2023-03-31", "quarter")), ("янв.23", ("2023-01-01", "2023-01-31", "month")), ("февраль 2024", ("2024-02-01", "2024-02-29", "month")),
        ("2023-12", ("2023-12-01", "2023-12-31", "month")), ("2023-02-15", None), ("2023-02-01", None), ("2022 vs 2023", None), ("утверждено 2023", None), ("", None),
        ("отчет за 2023 год", ("2023-01-01", "2023-12-31", "year")), ("Отчёт за 2023", ("2023-01-01", "2023-12-31", "year")), ("период 2023", ("2023-01-01", "2023-12-31", "year")), ("2023/12", ("2023-12-01", "2023-12-31", "month")),
        ("2023.12", ("2023-12-01", "2023-12-31", "month")), ("2023-1", ("2023-01-01", "2023-01-31", "month")), ("1 quarter 2023", ("2023-01-01", "2023-03-31", "quarter")), ("2023 q4", ("2023-10-01", "2023-12-31", "quarter")),
        ("marble 23", None), ("decor 23", None), ("Q1 2023 редакция", None), ("майский 23", None), ("май 23", ("2023-05-01", "2023-05-31", "month")),
    ],
)
def test_periods(spark, text, want):
    got = one(spark, P.parse_period(F.lit(text)))
    assert (got and (str(got.start), str(got.end), got.granularity)) == want


@pytest.mark.parametrize(("text", "fmt", "value", "reason"), [("1 234,5", "General", 1234.5, None), ("−7", "General", -7.0, None), ("0.8", "0%", 80.0, None), ("12 %", "General", 12.0, None), ("1,234", "General", None, "ambiguous"), ("=A1", "General", None, "formula"), ("abc", "General", None, "not_a_number"), ("1.234", "General", None, "ambiguous"), ("1,234 шт.", "General", None, "ambiguous"), ("0,125", "General", 0.125, None), ("5 пять", "General", None, "not_a_number"), ("5 тыс. руб.", "General", 5.0, None), ("12 345", "General", 12345.0, None), ("", "General", None, "empty")])
def test_numbers(spark, text, fmt, value, reason):
    got = one(spark, N.parse_number(F.lit(text), F.lit(fmt)))
    assert (got.value, got.reason) == (value, reason)


@pytest.mark.parametrize(("score", "want"), [(0, "weak"), (0.39, "weak"), (0.40, "review"), (0.69, "review"), (0.70, "high"), (0.89, "high"), (0.896, "very_high"), (0.90, "very_high"), (1.0, "very_high")])
def test_bands(spark, score, want):
    assert one(spark, N.band(F.lit(float(score)))) == want
    assert one(spark, N.clamp_score(F.lit(float(score)))) <= 0.99


def day(y, m, d=1):
    return dt.date(y, m, d)


def points(spark, rows, metric="delay", scope="A"):
    data = [(metric, scope, day(y, m), (day(y + m // 12, m % 12 + 1) - dt.timedelta(1)), float(v)) for y, m, v in rows]
    return spark.createDataFrame(data, "metric string, scope string, start date, end date, value double")


def event(spark, effective, units=("A",)):
    return spark.createDataFrame([("E", effective, list(units), [])], "event_id string, effective date, units array<string>, metric_codes array<string>")


def test_a_period_that_crosses_the_event_is_left_out(spark):
    rows = points(spark, [(2022, 10, 2), (2022, 11, 2), (2022, 12, 500), (2023, 1, 10), (2023, 2, 10)])
    got = compare.compare(rows, event(spark, day(2022, 12, 23))).first()
    assert (got.delta_abs, got.delta_pct, got.n_before, got.n_after, got.n_excluded) == (8.0, 400.0, 2, 2, 1)
    assert compare.compare(rows, event(spark, day(2023, 1, 1))).first().n_after == 1


def test_trend_is_taken_out(spark):
    base = [(2020, m, 100 + 0.01 * (day(2020, m).toordinal() + (day(2020 + m // 12, m % 12 + 1) - dt.timedelta(1)).toordinal()) / 2) for m in (1, 3, 9)]
    late = [(2021, m, 105 + 0.01 * (day(2021, m).toordinal() + (day(2021, m + 1) - dt.timedelta(1)).toordinal()) / 2) for m in (1, 2)]
    got = compare.compare(points(spark, base + late), event(spark, day(2020, 12, 15))).first()
    assert got.method == "trend_adjusted" and abs(got.adjusted_delta - 5) < 1e-6


def test_difference_in_differences_needs_a_clean_whole_control(spark):
    own = points(spark, [(2022, 1, 10), (2022, 2, 10), (2022, 6, 15), (2022, 7, 15)])
    other = points(spark, [(2022, 1, 5), (2022, 2, 5), (2022, 6, 8), (2022, 7, 8)], scope="B")
    control = lambda ok: spark.createDataFrame([("E", "A", "B", ok, "like A")], "event_id string, scope string, control_scope string, verified boolean, reason string")
    get = lambda o, c, units=("A",): compare.compare(own.union(o), event(spark, day(2022, 4, 10), units), c).where("scope = 'A'").first()
    assert (get(other, control(True)).method, get(other, control(True)).adjusted_delta) == ("diff_in_diff", 2.0)
    assert get(other, control(False)).method == "simple"
    assert get(other.where("value <> 5 or start <> '2022-02-01'"), control(True)).method == "simple"
    assert get(other, control(True), ("A", "B")).method == "simple"


def test_rollup_gives_reasons(spark):
    full = [(2021, m, 6) for m in range(1, 13)] + [(2022, m, 5) for m in range(1, 12)] + [(2023, m, 1) for m in (1, 2, 4, 12)]
    got = {r.start.year: (r.value, r.n_points, r.reason) for r in series.rollup(points(spark, full), "year", "sum").collect()}
    assert got == {2021: (72.0, 12, None), 2022: (None, 11, "incomplete"), 2023: (None, 4, "gap")}
    assert series.rollup(points(spark, [(2021, 1, 1), (2021, 1, 2)]), "quarter", "sum").first().reason == "overlap"


@pytest.mark.parametrize(("values", "want"), [("AAA", "arr"), ("AAB", "qrq"), ("ABA", "qqq"), ("AABA", "qrqq"), ("AB", "qq")])
def test_conflict_queue(spark, values, want):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, at int, v string")
    got = series.conflict_queue(rows, ["k"], "at", "v").orderBy("at").collect()
    assert "".join(r.state[0] for r in got) == want


def test_levels(spark):
    base = {"n_before": 3, "n_after": 3, "method": "trend_adjusted", "delta_abs": 10.0, "adjusted_delta": 9.0, "alternatives": 0, "listed": True, "confirmed": True, "assumption_warning": False}
    cases = [({}, "high"), ({"n_after": 1}, "insufficient"), ({"adjusted_delta": 1.0}, "insufficient"), ({"listed": False}, "insufficient"), ({"confirmed": False}, "low"), ({"alternatives": 1}, "medium"), ({"alternatives": 1, "method": "simple"}, "low"), ({"assumption_warning": True}, "medium")]
    rows = spark.createDataFrame([{**base, **c, "k": i} for i, (c, _) in enumerate(cases)])
    assert [r.level for r in compare.attribution_level(rows).orderBy("k").collect()] == [w for _, w in cases]


def test_registry(spark):
    cases = spark.createDataFrame([("p", "A", day(2020, 1), 10.0), ("p", "B", day(2020, 1), 20.0), ("p", "A", day(2021, 1), 30.0), ("q", "A", day(2020, 1), 5.0)], "pattern string, scope string, effective date, delta_pct double")
    got = {r.pattern: (r.n_cases, r.mean_delta_pct, r.low, r.high) for r in registry.knowledge(cases).collect()}
    assert got == {"p": (3, 20.0, 10.0, 30.0), "q": (1, None, 5.0, 5.0)}
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, version int, v string")
    new = spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], "k int, version int, v string")
    assert {r.k: r.v for r in registry.upsert(old, new, ["k"], ["version"]).collect()} == {1: "c", 2: "b", 3: "d"}
    assert [r.k for r in registry.retract(old, new, ["k"]).collect()] == [2]


RU = ["Осуществляет контроль исполнения бюджета подразделений компании", "Готовит отчёт о рисках", "5.3.1. Проводит аудит закупок;", "не имеет права подписывать договоры"]


def test_text_functions(spark):
    assert one(spark, T.clause(F.lit(RU[2]))) == "5.3.1" and one(spark, T.body(F.lit(RU[2]))).startswith("Проводит")
    assert one(spark, T.norm(F.lit("Отчёт, №5 (ВНД)"))) == "отчет 5 внд"
    assert one(spark, T.role(F.lit(RU[2]))) == "control" and one(spark, T.role(F.lit(RU[1]))) == "execute"
    assert one(spark, T.norm_type(F.lit(RU[3]), F.lit("duty"))) == "prohibition" and one(spark, T.norm_type(F.lit("обязан готовить отчет"), F.lit("right"))) == "duty"
    assert [one(spark, T.stem(F.lit(w))) for w in ("готовит", "проведение", "закупок", "рисками", "отдел", "процессами")] == ["подгот", "провод", "закупок", "риск", "отдел", "процесс"]
    assert "подгот" in one(spark, T.actions(F.lit(RU[1]))) and one(spark, T.first_action(F.lit(RU[1]))).at == 0


def test_similarity_is_the_weighted_sum(spark):
    a, b = "готовит отчет о рисках банка", "готовит сводный отчет о рисках"
    ta, tb = (one(spark, T.tokens(F.lit(x))) for x in (a, b))
    want = 0.55 * len(set(ta) & set(tb)) / len(set(ta) | set(tb)) + 0.25 * len(set(ta) & set(tb)) / min(len(ta), len(tb)) + 0.20 * difflib.SequenceMatcher(None, " ".join(sorted(ta)), " ".join(sorted(tb))).ratio()
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    got = rows.select(T.similarity(T.norm(F.col("a")), T.norm(F.col("b")), T.tokens(F.col("a")), T.tokens(F.col("b")))).first()[0]
    assert abs(got - want) < 1e-12


def assignments(spark, rows):
    data = [(i, f"f{i}", p, u, t, "duty", r, "", True) for i, (p, u, t, r) in enumerate(rows)]
    return spark.createDataFrame(data, "fn_ord long, fn_id string, period string, unit string, text string, norm_type string, role string, scope string, owner_known boolean")


def test_matrix_statuses(spark):
    keep, gone, fresh = "проводит сверку остатков на счетах клиентов банка", "обеспечивает хранение архива договоров поставки оборудования", "разрабатывает методику оценки поставщиков услуг связи"
    rows = [("before", "A", keep, "execute"), ("before", "A", gone, "execute"), ("before", "B", "готовит ежемесячный отчет о рисках ликвидности банка", "execute"), ("after", "A", keep, "execute"), ("after", "C", "готовит ежемесячный отчет о рисках ликвидности банка", "execute"), ("after", "B", fresh, "execute")]
    got = {r.label: r.status for r in matching.ownership_matrix(assignments(spark, rows)).collect()}
    assert got == {keep: "preserved", gone: "lost", rows[2][2]: "moved", fresh: "new"}


def test_conflicts_need_two_objects(spark):
    rows = [("after", "A", "проверяет лимиты казначейства по валютным сделкам", "control"), ("after", "A", "заключает валютные сделки казначейства в пределах лимитов", "execute"), ("after", "B", "заключает валютные сделки", "execute")]
    got = matching.conflicts(assignments(spark, rows)).collect()
    assert [(r.unit, r.control_id, r.execute_id) for r in got] == [("A", "f0", "f1")]


def test_fragments_carry_clauses(spark):
    docs = spark.createDataFrame([("d", "intro\n5.1. First\n\n а) part\n5.2 Second")], "name string, text string")
    got = [(r.line_no, r.locator, r.text) for r in lines.fragments(docs, "name", "text").orderBy("line_no").collect()]
    assert got == [(1, "", "intro"), (2, "5.1", "5.1. First"), (4, "5.1", "а) part"), (5, "5.2", "5.2 Second")]
    assert lines.limit_errors(docs, "name", "text", 3).count() == 1


def test_batches_keep_sources_whole(spark):
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate([40, 30, 50, 200, 20])], "k string, at int, n int")
    got = claims.pack_batches(rows, "k", "at", "n", budget=100, most=2).orderBy("ord").collect()
    assert [r.batch for r in got] == [0, 0, 1, -1, 1]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_near_duplicate_findings_by_brute_force(spark, least):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("ab"), rnd.sample(range(9), rnd.randint(0, 7))) for i in range(160)]
    rows += [(200 + i, "c", [x for x in range(25) if x not in (i, 2 * i)]) for i in range(12)] + [(300, None, [1]), (301, None, [1])]
    got = claims.near_duplicate_findings(spark.createDataFrame(rows, "finding_id long, kind string, sources array<long>"), least).collect()
    want = [(i, j) for i, k, s in rows for j, l, t in rows if i > j and k == l and k and set(s) & set(t) and len(set(s) & set(t)) >= least * len(set(s) | set(t))]
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize(("least", "subsets"), [(0.3, 500), (0.8, 500), (0.5, 6), (0.8, 2)])
def test_linked_findings_by_brute_force(spark, monkeypatch, least, subsets):
    """One row a finding, with every link counted, whether subsets alone tell that two sets are linked or sets are compared."""
    monkeypatch.setattr(claims, "SUBSETS", subsets)
    rnd = random.Random(11)
    rows = [(i, rnd.choice("ab"), rnd.sample(range(9), rnd.randint(0, 7))) for i in range(160)]
    rows += [(200 + i, "c", [x for x in range(25) if x not in (i, 2 * i)]) for i in range(12)] + [(300, None, [1]), (301, None, [1]), (302, "a", None)]
    got = claims.linked_findings(spark.createDataFrame(rows, "finding_id long, kind string, sources array<long>"), least).collect()
    near = lambda s, t: bool(s & t) and len(s & t) >= least * len(s | t)
    want = []
    for i, k, s in rows:
        links = [j for j, l, t in rows if j != i and k and k == l and near(set(s or ()), set(t or ()))]
        same = [j for j, l, t in rows if k and k == l and s and set(s) == set(t or ())]
        want.append((i, min(same, default=i), len(links), min([j for j in links if j < i], default=None)))
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_near_duplicate_findings_of_later_orders(spark, tmp_path):
    """Orders beyond the first 2000 are compared too."""
    spark.createDataFrame([(7, "1-URGENT"), (5000, "1-URGENT"), (6000, "2-HIGH")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 3), (5000, 28), (6000, 3)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    from ledgershift import plans

    assert sorted(tuple(r) for r in plans.QUERIES["finding_dedupe_jaccard"](spark, str(tmp_path)).collect()) == [(7, 7, 1, None), (5000, 7, 1, 7), (6000, 6000, 0, None)]


@pytest.mark.parametrize(("label", "key"), [("Выявлено нарушений (существенных)", "выявлено нарушений существенных"), ("План, факт", "план факт"), ("Всего; шт.", "всего"), ("Доля (%)", "доля"), ("Отчёт, дней", "отчет")])
def test_label_keys(spark, label, key):
    assert one(spark, T.label_key(F.lit(label))) == key


@pytest.mark.parametrize(("quote", "value", "plain", "human"), [("сумма 12 345", 12345.0, True, True), ("A12345", 12345.0, False, False), ("итого 1,234", 1234.0, False, True), ("итого 1,234", 1.234, True, True), ("12,5 дня", 12.5, True, True)])
def test_literals(spark, quote, value, plain, human):
    assert one(spark, N.literal_in(F.lit(value), F.lit(quote))) is plain and one(spark, N.literal_in(F.lit(value), F.lit(quote), grouped=True)) is human


def test_aliases_resolve(spark):
    from ledgershift.operators import catalog as K
    from ledgershift.operators import explore as X

    rows = spark.createDataFrame([(1, "Проведено проверок"), (2, "Количество проверок"), (3, "Задержка отчётов, дней"), (4, "Нечто"), (5, "FTE")], "k int, label string")
    got = {r.k: (list(r.codes), r.state) for r in X.resolve_labels(rows, "k", "label", K.catalogue(spark).select("label", "code")).collect()}
    assert got == {1: (["audits_done"], "resolved"), 2: (["audits_done", "audits_planned"], "ambiguous"), 3: (["report_delay_days"], "resolved"), 4: ([], "unknown"), 5: (["fte_actual"], "resolved")}
