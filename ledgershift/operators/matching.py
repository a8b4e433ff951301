"""Assignments before and after a change: similarity edges, row clustering, statuses, unit changes, findings, scores.

assignments: fn_ord, fn_id, period (before, after), unit, text, norm_type, role, scope, owner_known.

Equal texts are one in the search for pairs. Only pairs that can reach the threshold are scored: the rarest tokens meet,
and the score's bound s <= .45 + .55 Jaccard drops the rest before letters are aligned. Clustering is sequential by
meaning, but a row never leaves a connected component of the pairs that can join, so a component is one pandas call.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GENERAL_OBJECTS, actions, body, first_action, jaccard, norm, similarity, tokens
from ..session import materialize, ship
from .components import components

JOIN_NEW, JOIN_OLD, PLAUSIBLE = 0.88, 0.78, 0.56


def prepared(assignments: DataFrame) -> DataFrame:
    """assignments with n (normal form), t (tokens), a (action stems), f (first action); a written table, as stems are long expressions."""
    ship(assignments.sparkSession)
    plain = body(F.col("text"))
    return materialize(assignments.withColumns({"n": norm(plain), "t": tokens(plain), "a": actions(F.col("text")), "f": first_action(F.col("text"))}), "assignments")


def rare_first(rows: DataFrame) -> DataFrame:
    """(fn_ord, norm_type, role, t, r): the tokens of a text, those of the fewest texts of its kind first in r."""
    item = rows.select("fn_ord", "norm_type", "role", F.explode("t").alias("token"))
    held = item.groupBy("norm_type", "role", "token").agg(F.count("*").alias("df"))
    order = item.join(held, ["norm_type", "role", "token"]).groupBy("fn_ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("r"))
    return rows.select("fn_ord", "norm_type", "role", "t").join(order, "fn_ord")


def token_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(x, y), x > y: pairs of one norm type and role whose token sets have a Jaccard similarity of `least` or more, above 0.

    Two such sets share one of the rarest tokens of either, the first size - ceil(least * size) + 1: only those are met.
    """
    ready = rare_first(rows)
    n = F.size("r")
    head = F.slice("r", 1, F.greatest(n - F.ceil(n * least - 1e-9).cast("int") + 1, F.lit(1))) if least > 0 else F.col("r")
    one = materialize(ready.select("fn_ord", "norm_type", "role", n.alias("n"), F.explode(head).alias("token")), "prefixes")
    a, b = one.alias("a"), one.alias("b")
    met = a.join(b, ["norm_type", "role", "token"]).where(F.col("a.fn_ord") > F.col("b.fn_ord"))
    met = met.where((F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9)).select(F.col("a.fn_ord").alias("x"), F.col("b.fn_ord").alias("y")).distinct()
    sets = ready.select("fn_ord", "t")
    full = met.join(sets.select(F.col("fn_ord").alias("x"), F.col("t").alias("xt")), "x").join(sets.select(F.col("fn_ord").alias("y"), F.col("t").alias("yt")), "y")
    return full.where(jaccard(F.col("xt"), F.col("yt")) >= least - 1e-9).select("x", "y")


def _place(period: str, fn_ord: str) -> Column:
    """Where an assignment stands: all before, then all after."""
    return F.struct((F.col(period) == "after").alias("late"), F.col(fn_ord).alias("fn_ord"))


def texts_of(rows: DataFrame) -> DataFrame:
    """(fn_ord, rep): rep is the first assignment of the same norm type, role and normal form, before ones first."""
    first = rows.groupBy("norm_type", "role", "n").agg(F.min_by("fn_ord", _place("period", "fn_ord")).alias("rep"))
    return rows.select("fn_ord", "norm_type", "role", "n").join(first, ["norm_type", "role", "n"]).select("fn_ord", "rep")


def edges(rows: DataFrame, least: float = PLAUSIBLE) -> DataFrame:
    """(a_ord, b_ord, s): different texts of one norm type and role with s >= least, known by their first assignments; a is the later one.

    Letters are aligned in that order, as the ratio depends on it.
    The score is at most .45 + .55 Jaccard, or lifted where one set holds nearly all of the other; pairs below are not met.
    """
    texts = rows.join(texts_of(rows).where("fn_ord = rep").select("fn_ord"), "fn_ord")
    bound = max(0.0, min((least - 0.45) / 0.55, 0.42))
    late = lambda c: texts.select(F.col("fn_ord").alias(c), (F.col("period") == "after").alias(f"{c}_late"))
    met = token_pairs(texts, bound).join(late("x"), "x").join(late("y"), "y")  # x > y
    turned = F.col("y_late") & ~F.col("x_late")
    pair = materialize(met.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("a_ord"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("b_ord")), "pairs")
    full = pair.join(side(texts, "a"), "a_ord").join(side(texts, "b"), "b_ord")
    full = full.withColumn("s", similarity(F.col("a_n"), F.col("b_n"), F.col("a_t"), F.col("b_t"), least)).withColumn("s", guarded())
    return materialize(full.where((F.col("s") > 0) & (F.col("s") >= least)).select("a_ord", "b_ord", "s"), "edges")


def member_edges(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(x, y, s), x > y: the same for all assignments that have those texts, and s = 1 for one text's; as many rows as pairs of copies.

    Copies of a pair of texts have the similarity of the first two.
    """
    of = texts_of(rows)
    a, b = of.select(F.col("rep").alias("a_ord"), F.col("fn_ord").alias("x")), of.select(F.col("rep").alias("b_ord"), F.col("fn_ord").alias("y"))
    apart = links.join(a, "a_ord").join(b, "b_ord").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"), "s")
    same = a.join(b, F.col("a_ord") == F.col("b_ord")).where("x > y").select("x", "y", F.lit(1.0).alias("s"))
    return apart.unionByName(same)


def side(rows: DataFrame, p: str, *more: str) -> DataFrame:
    """One side of pairs: prepared columns and `more`, their names after p and an underscore; fn_ord as p_ord."""
    return rows.select(F.col("fn_ord").alias(f"{p}_ord"), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "t", "a", "f", *more)))


def guarded() -> Column:
    """The similarity s of a pair of sides a and b, for assignments of one norm type and role.

    0 where both begin with an action, the actions differ, and no shared action with s of .70 speaks for a split duty;
    .82 at least where one side's tokens are nearly all in the other.
    """
    least, most = F.least(F.size("a_t"), F.size("b_t")), F.greatest(F.size("a_t"), F.size("b_t"))
    held = (least >= 5) & (least / most >= 0.45) & (F.size(F.array_intersect("a_t", "b_t")) / least >= 0.96)
    both = F.coalesce((F.col("a_f.at") < 12) & (F.col("b_f.at") < 12), F.lit(False))
    same = F.coalesce(F.col("a_f.stem") == F.col("b_f.stem"), F.lit(False)) | (F.arrays_overlap("a_a", "b_a") & (F.col("s") >= 0.70))
    return F.when(both & ~same, 0.0).when(held, F.greatest("s", F.lit(0.82))).otherwise(F.col("s"))


def _fold(members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Leader clustering of one component in order: all before, then all after; the best row is chosen first, then its threshold applies.

    A text that stands already goes to its row, whose similarity is 1.
    """
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, s in links[["a_ord", "b_ord", "s"]].itertuples(index=False):
        near.setdefault(a, []).append((b, s))
        near.setdefault(b, []).append((a, s))
    row_of: dict[int, int] = {}  # of texts
    at: dict[int, int] = {}
    rows: list[dict] = []
    ordered = members.assign(late=members["period"] == "after").sort_values(["late", "fn_ord"])
    for o, text, period, unit in ordered[["fn_ord", "rep", "period", "unit"]].itertuples(index=False):
        best: dict[int, float] = {row_of[text]: 1.0} if text in row_of else {}
        for other, s in near.get(text, ()):
            if other in row_of:
                best[row_of[other]] = max(best.get(row_of[other], 0.0), s)
        chosen = max(best, key=lambda r: (best[r], unit in rows[r]["units"], -r), default=None)
        if chosen is not None and best[chosen] < (JOIN_NEW if period == "before" or not rows[chosen]["old"] else JOIN_OLD):
            chosen = None
        if chosen is None:
            rows.append({"first": o, "units": set(), "old": False})
            chosen = len(rows) - 1
        rows[chosen]["units"].add(unit)
        rows[chosen]["old"] |= period == "before"
        row_of.setdefault(text, chosen)
        at[o] = chosen
    return pd.DataFrame({"row_ord": [rows[at[o]]["first"] for o in members["fn_ord"]], "fn_ord": members["fn_ord"]})


def cluster(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(row_ord, fn_ord): a matrix row is known by its first member. Members are ordered before, then after.

    A row never leaves a connected component of the links that can join, so each component is a call of its own; a text
    without a link is a row at once. links: of different texts, as edges() gives them.
    """
    able = links.where(F.col("s") >= JOIN_OLD)
    of = components(able.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b")))
    placed = texts_of(rows).join(of.select(F.col("v").alias("rep"), "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    held = able.join(of.select(F.col("v").alias("a_ord"), "c"), "a_ord", "left").select(F.coalesce("c", "a_ord").alias("c"), "a_ord", "b_ord", "s")
    tied = held.select("c").distinct()
    members = placed.join(rows.select("fn_ord", "period", "unit"), "fn_ord")
    alone = members.join(tied, "c", "left_anti").select(F.col("rep").alias("row_ord"), "fn_ord")
    some = members.join(tied, "c", "left_semi").select("c", "fn_ord", "rep", "period", "unit").groupBy("c").cogroup(held.groupBy("c"))
    return materialize(some.applyInPandas(lambda m, e: _fold(m, e), "row_ord long, fn_ord long").unionByName(alone), "rows")


def row_status(members: DataFrame, plausible: DataFrame | None = None, incomplete: bool = False) -> DataFrame:
    """row_ord, status, owners_before, owners_after, candidate_overlap from members(row_ord, period, unit, n, norm_type, owner_known).

    plausible: row_ord of rows without a match that still have a similar assignment; absence is then unknown, not lost.
    """
    old, new = F.col("period") == "before", F.col("period") == "after"
    known = F.col("owner_known")
    own = lambda side: F.array_sort(F.collect_set(F.when(side & known, F.col("unit"))))
    text = lambda side: F.array_sort(F.collect_set(F.when(side, F.col("n"))))
    rows = members.groupBy("row_ord").agg(
        F.bool_and(known).alias("known"), F.count_if(old).alias("n_old"), F.count_if(new).alias("n_new"), own(old).alias("owners_before"), own(new).alias("owners_after"),
        text(old).alias("x"), text(new).alias("y"), F.first("norm_type").alias("norm_type"),
    )
    hint = F.lit(incomplete)
    if plausible is not None:
        rows = rows.join(plausible.select("row_ord", F.lit(True).alias("hint")).distinct(), "row_ord", "left")
        hint = hint | F.coalesce("hint", F.lit(False))
    status = (
        F.when(~F.col("known"), "unknown")
        .when((F.col("n_new") == 0) & hint, "unknown")
        .when(F.col("n_new") == 0, "lost")
        .when(F.col("n_old") == 0, "new")
        .when(F.col("owners_before") != F.col("owners_after"), "moved")
        .when(F.col("x") == F.col("y"), "preserved")
        .otherwise("changed")
    )
    return rows.select("row_ord", status.alias("status"), "owners_before", "owners_after", ((F.col("norm_type") == "duty") & (F.size("owners_after") > 1)).alias("candidate_overlap"))


def near_rows(rows: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(row_ord): rows with a member before whose text, or one linked to it, stands after."""
    of = texts_of(rows)
    late = rows.where("period = 'after'").join(of, "fn_ord").select("rep").distinct()
    both = links.select(F.col("a_ord").alias("mine"), F.col("b_ord").alias("rep")).union(links.select("b_ord", "a_ord"))
    reached = both.join(late, "rep").select("mine").union(late).distinct()
    early = members.where("period = 'before'").select("fn_ord", "row_ord").join(of, "fn_ord")
    return early.join(reached.withColumnRenamed("mine", "rep"), "rep").select("row_ord").distinct()


def ownership_matrix(assignments: DataFrame, incomplete: bool = False) -> DataFrame:
    """The whole before/after matrix: row_ord, label, status, owners_before, owners_after, candidate_overlap."""
    rows = prepared(assignments)
    links = edges(rows)
    members = materialize(rows.join(cluster(rows, links), "fn_ord"), "members")
    plausible = near_rows(rows, members, links)
    label = rows.select(F.col("fn_ord").alias("row_ord"), F.col("text").alias("label"))
    return row_status(members, plausible, incomplete).join(label, "row_ord")


def conflicts(assignments: DataFrame) -> DataFrame:
    """unit, control_id, execute_id, objects: one unit controls and executes what shares two objects or more, scopes not apart."""
    rows = prepared(assignments.where("norm_type = 'duty' and owner_known"))
    general = F.array(*(F.lit(x) for x in GENERAL_OBJECTS))
    check = rows.where("role = 'control'").select("unit", F.col("fn_id").alias("control_id"), F.col("fn_ord").alias("c_ord"), F.col("t").alias("ct"), F.col("scope").alias("cs"))
    run = rows.where("role = 'execute'").where(~F.col("text").rlike("(?iU)аудит|провер|оценк|мониторинг|контрол"))
    run = run.select("unit", F.col("fn_id").alias("execute_id"), F.col("fn_ord").alias("e_ord"), F.col("t").alias("et"), F.col("scope").alias("es"))
    both = check.join(run, "unit").withColumn("objects", F.array_sort(F.array_except(F.array_intersect("ct", "et"), general)))
    both = both.where((F.size("objects") >= 2) & ((F.col("cs") == "") | (F.col("es") == "") | (F.col("cs") == F.col("es"))))
    first = Window.partitionBy("unit", "objects").orderBy("c_ord", "e_ord")
    return both.withColumn("k", F.row_number().over(first)).where("k = 1").select("unit", "control_id", "execute_id", "objects")


def support(text: Column, action: Column, objects: Column) -> Column:
    """How strongly two assignments support one another."""
    return 0.55 * text + 0.20 * action + 0.25 * objects
