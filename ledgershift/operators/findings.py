"""From assignments of two editions to findings: split duties, best matches, row scores, losses, duplicates, conflicts, units.

A comparison is one pair of packages, `before` and `after`; sizes are those of two document editions. Rows of the matrix
are known by their first member's number (row_ord), as in matching.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import band
from ..session import materialize
from . import matching as M
from . import scoring as S
from .assignments import CHIEF, COMMON, ROLE, UNKNOWN
from .numbering import numbered

#: Numbers of after-assignments come behind all before ones.
LATE = 1 << 40
# Markers of roles in a cell of the matrix.
MARKERS = {"execute": "И", "participate": "У", "approve": "Т", "agree": "С", "coordinate": "Ко", "control": "К"}


def ordered(assignments: DataFrame) -> DataFrame:
    """assignments(package = before or after, ...) with period, and fn_ord numbers that are unique over both."""
    rows = assignments.withColumn("period", F.col("package"))
    return rows.withColumn("fn_ord", F.col("fn_ord") + F.when(F.col("period") == "after", LATE).otherwise(0))


def _greedy_splits(pairs: pd.DataFrame) -> pd.DataFrame:
    taken, out = set(), []
    for old, some in pairs.sort_values(["old_row", "new_row"]).groupby("old_row", sort=True):
        best: dict[str, tuple[int, int]] = {}
        for row in some.itertuples(index=False):
            if row.new_row not in taken and row.shared > best.get(row.action, (0, 0))[0]:
                best[row.action] = (row.shared, row.new_row)
        chosen = {new for _, new in best.values()}
        if len(best) >= 2 and len(chosen) >= 2:
            taken |= chosen
            out += [(old, new) for new in sorted(chosen)]
    return pd.DataFrame(out, columns=["row_ord", "part_ord"])


def split_rows(members: DataFrame) -> DataFrame:
    """(row_ord, part_ord): rows after that are parts of a compound duty before, two parts or more, for two of its actions.

    Candidates share an action and two objects; greedy in the order of rows, so one small call a norm type.
    """
    label = Window.partitionBy("row_ord").orderBy("fn_ord")
    rows = members.select("row_ord", "norm_type", "period", "fn_ord", "text").withColumn("k", F.row_number().over(label)).groupBy("row_ord", "norm_type").agg(
        F.bool_and(F.col("period") == "before").alias("old"), F.bool_and(F.col("period") == "after").alias("new"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fn_ord", "text"))), lambda x: x["text"]), " ").alias("all_text"), F.max(F.when(F.col("k") == 1, F.col("text"))).alias("label"),
    )
    objects = lambda x: F.array_except(T.tokens(x), T.actions(x))
    old = rows.where("old").select("norm_type", F.col("row_ord").alias("old_row"), T.actions(F.col("all_text")).alias("acts"), objects(F.col("all_text")).alias("objs")).where(F.size("acts") >= 2)
    new = rows.where("new").select("norm_type", F.col("row_ord").alias("new_row"), F.explode(T.actions(F.col("label"))).alias("action"), objects(F.col("label")).alias("own"))
    old, new = materialize(old, "old-rows"), materialize(new, "new-rows")
    pairs = old.withColumn("action", F.explode("acts")).join(new, ["norm_type", "action"]).withColumn("shared", F.size(F.array_intersect("objs", "own"))).where("shared >= 2")
    return pairs.select("norm_type", "old_row", "new_row", "action", "shared").groupBy("norm_type").applyInPandas(lambda g: _greedy_splits(g), "row_ord long, part_ord long")


def _sorted_set(x: Column) -> Column:
    return F.array_sort(F.collect_set(x))


def _department(unit: Column) -> Column:
    return ~(F.contains(unit, F.lit(COMMON)) | unit.startswith(ROLE) | (unit == CHIEF))


def matrix(assignments: DataFrame, incomplete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, members): row_ord, row_id, label, norm_type, status, owners, candidate_overlap, scopes, split; and the members with prepared columns.

    incomplete: warnings on the documents after, so that what is not found may be there.
    """
    rows = M.prepared(ordered(assignments))
    links = M.edges(rows)
    members = materialize(rows.join(M.cluster(rows, links), "fn_ord"), "clustered")
    parts = materialize(split_rows(members), "split-rows")
    members = members.join(parts.select(F.col("row_ord").alias("whole"), F.col("part_ord").alias("row_ord")), "row_ord", "left")
    members = materialize(members.withColumn("row_ord", F.coalesce("whole", "row_ord")).drop("whole"), "members")
    near = M.near_rows(rows, members, links)
    short = _short_forms(rows, members)
    status = M.row_status(members, near.union(short), incomplete).drop("candidate_overlap")
    head = Window.partitionBy("row_ord").orderBy("fn_ord")
    first = members.withColumn("k", F.row_number().over(head)).where("k = 1").select("row_ord", F.col("text").alias("label"), "norm_type", F.substring(F.sha2(F.concat_ws("|", "norm_type", "role", T.norm(F.col("text"))), 256), 1, 14).alias("digest"))
    own = (F.col("period") == "after") & F.col("owner_known") & _department(F.col("unit"))
    over = members.groupBy("row_ord").agg(F.count_distinct(F.when(own, F.col("unit"))).alias("departments"), _sorted_set(F.when((F.col("period") == "after") & (F.col("scope") != ""), F.col("scope"))).alias("scopes"))
    out = status.join(first, "row_ord").join(over, "row_ord").join(parts.select("row_ord", F.lit(True).alias("split")).distinct(), "row_ord", "left")
    out = out.withColumns({"candidate_overlap": (F.col("norm_type") == "duty") & (F.col("departments") > 1), "split": F.coalesce("split", F.lit(False)), "row_id": F.concat(F.lit("row:"), "digest")})
    out = out.select("row_ord", "row_id", "label", "norm_type", "status", "owners_before", "owners_after", "candidate_overlap", "scopes", "split")
    return materialize(out, "matrix"), members


def _short_forms(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(row_ord): rows before of which an assignment after may be a short form.

    A short form has two to four tokens and three quarters of them in the long one, so one of its rarest tokens is there.
    """
    of = M.texts_of(rows)
    texts = rows.join(of.where("fn_ord = rep"), "fn_ord").select("fn_ord", "norm_type", "role", "t", F.col("f.stem").alias("stem"), "text")
    side = lambda period: of.join(rows.where(F.col("period") == period).select("fn_ord"), "fn_ord").select(F.col("rep").alias("fn_ord")).distinct()
    late = texts.join(side("after"), "fn_ord").where(F.size("t").between(2, 4) & F.col("stem").isNotNull())
    ready = M.rare_first(texts).select("fn_ord", "r")
    n = F.size("r")
    late = late.join(ready, "fn_ord").select("norm_type", "role", "stem", F.col("t").alias("new_t"), F.col("text").alias("new_text"), F.explode(F.slice("r", 1, n - F.ceil(n * 0.75).cast("int") + 1)).alias("token"))
    early = texts.join(side("before"), "fn_ord").select("fn_ord", "norm_type", "role", "stem", F.col("t").alias("old_t"), F.col("text").alias("old_text"), F.explode("t").alias("token"))
    met = early.join(late, ["norm_type", "role", "stem", "token"]).where(T.possible_abbreviation(F.col("old_text"), F.col("new_text"), F.col("old_t"), F.col("new_t")))
    held = met.select(F.col("fn_ord").alias("rep")).distinct().join(of, "rep").select("fn_ord")
    return members.where("period = 'before'").join(held, "fn_ord").select("row_ord").distinct()


def notes(rows: DataFrame) -> DataFrame:
    """row_ord, note: what a reviewer should look at, by status, overlap, scopes, split and norm."""
    status = F.col("status")
    found = F.array(
        F.when(F.col("split"), "split_duty"),
        F.when(status == "unknown", F.when(F.size("owners_after") + F.size("owners_before") == 0, "owner_unknown").otherwise("check_wording_or_completeness")).when(status == "lost", "no_direct_assignment").when(status == "moved", "owners_changed").when(status == "changed", "wording_changed"),
        F.when(F.col("candidate_overlap"), F.when(F.size("scopes") > 1, "several_owners_with_scopes").otherwise("several_owners")),
        F.when(F.col("norm_type") == "prohibition", "prohibition_is_no_duty"),
    )
    return rows.select("row_ord", F.explode(F.array_compact(found)).alias("note"))


def _pair_signals(pairs: DataFrame) -> DataFrame:
    """pairs of sides a and b with text, action and object signals, and their support."""
    text = T.similarity(F.col("a_n"), F.col("b_n"), F.col("a_t"), F.col("b_t"))
    action, objects = S.signals(F.col("a_t"), F.col("a_a"), F.col("b_t"), F.col("b_a"))
    rows = pairs.withColumns({"s": text, "action": action, "object": objects})
    return rows.withColumn("support", S.support(F.col("s"), F.col("action"), F.col("object"), F.col("a_norm_type") == F.col("b_norm_type")))


def _pairs(members: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of members of one row: one of period a with one of period b."""
    more = ("norm_type", "role", "unit", "scope", "frag_id", "owner_known", "fn_id")
    left = M.side(members.where(F.col("period") == a), "a", "row_ord", *more).withColumnRenamed("a_row_ord", "row_ord")
    right = M.side(members.where(F.col("period") == b), "b", "row_ord", *more).withColumnRenamed("b_row_ord", "row_ord")
    return left.join(right, "row_ord")


def best_matches(members: DataFrame) -> DataFrame:
    """before_id, after_id, similarity: for each member before the best after in its row, the same unit first among equals."""
    pairs = _pairs(members, "before", "after").withColumn("s", T.similarity(F.col("a_n"), F.col("b_n"), F.col("a_t"), F.col("b_t")))
    pairs = pairs.withColumn("s", F.when((F.col("a_norm_type") == F.col("b_norm_type")) & (F.col("a_role") == F.col("b_role")), M.guarded()).otherwise(0.0))
    best = Window.partitionBy("a_ord").orderBy(F.desc("s"), (F.col("a_unit") == F.col("b_unit")).desc(), "b_ord")
    found = pairs.withColumn("k", F.row_number().over(best)).where("k = 1").select(F.col("a_fn_id").alias("before_id"), F.col("b_fn_id").alias("after_id"), F.round("s", 6).alias("similarity"))
    alone = members.where("period = 'before'").select(F.col("fn_id").alias("before_id")).join(found, "before_id", "left_anti")
    none = F.lit(None).cast("string")
    old = members.where("period = 'before'").select("row_ord").distinct()
    made = members.where("period = 'after'").join(old, "row_ord", "left_anti").select(none.alias("before_id"), F.col("fn_id").alias("after_id"), F.lit(0.0).alias("similarity"))
    return found.unionByName(alone.select("before_id", none.alias("after_id"), F.lit(0.0).alias("similarity"))).unionByName(made)


def package_state(assignments: DataFrame, warnings: int = 0, complete: bool = False) -> dict:
    """What scores need to know of the whole: known owners' share after, unknown ones, whether extraction was clean."""
    late = F.col("package") == "after"
    n, unknown, owners = assignments.agg(F.count_if(late), F.count_if(late & ~F.col("owner_known")), F.count_distinct(F.when(late & F.col("owner_known"), F.col("unit")))).first()
    return {"n": n, "unknown": unknown, "owners": owners, "ratio": 1 - unknown / n if n else 0.0, "clean": n > 0 and warnings == 0, "complete": complete}


def nearest_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sides a and b that share a stem, with s, action, object and support, where a pair can matter: as a member's strongest of its norm, or at a threshold.

    The sum without the aligned letters, and with all of them, bound the support of a pair from below and above. A pair
    is left out if it can neither be its member's strongest nor reach .55, nor be a part (object .35, s .30).
    """
    word = lambda side, p: side.select(f"{p}_ord", F.explode(f"{p}_t").alias("w"))
    met = word(old, "a").join(word(new, "b"), "w").select("a_ord", "b_ord").distinct()
    pairs = met.join(old, "a_ord").join(new, "b_ord")
    action, objects = S.signals(F.col("a_t"), F.col("a_a"), F.col("b_t"), F.col("b_a"))
    plain = 0.55 * T.jaccard(F.col("a_t"), F.col("b_t")) + 0.25 * T.containment(F.col("a_t"), F.col("b_t"))
    lengths = F.length(F.array_join("a_t", " ")), F.length(F.array_join("b_t", " "))
    most = 0.2 * 2 * F.least(*lengths) / (lengths[0] + lengths[1])
    same_norm, equal = F.col("a_norm_type") == F.col("b_norm_type"), F.col("a_n") == F.col("b_n")
    pairs = pairs.withColumns({"action": action, "object": objects, "low_s": F.when(equal, 1.0).otherwise(plain), "high_s": F.when(equal, 1.0).otherwise(plain + most)})
    pairs = pairs.withColumns({f"{x}_support": S.support(F.col(f"{x}_s"), F.col("action"), F.col("object"), same_norm) for x in ("low", "high")})
    pairs = materialize(pairs, "near-pairs")
    best = pairs.groupBy("a_ord").agg(F.max("low_support").alias("floor"))
    able = (F.col("high_support") >= F.col("floor") - 1e-9) | (F.col("high_support") >= 0.55) | ((F.col("object") >= 0.35) & (F.col("high_s") >= 0.30) & same_norm)
    pairs = pairs.join(best, "a_ord").where(able).drop("low_s", "high_s", "low_support", "high_support", "floor")
    pairs = pairs.withColumn("s", T.similarity(F.col("a_n"), F.col("b_n"), F.col("a_t"), F.col("b_t")))
    return pairs.withColumn("support", S.support(F.col("s"), F.col("action"), F.col("object"), same_norm))


def loss_scores(rows: DataFrame, members: DataFrame, state: dict) -> DataFrame:
    """row_ord, strongest, transfer, parts, score of lost rows that are no prohibitions.

    The nearest text after is the evidence; texts that share no stem are none. Letters are aligned only for pairs that can
    be a member's nearest, or reach a threshold.
    """
    more = ("norm_type", "unit", "owner_known", "frag_id")
    lost = rows.where("status = 'lost' and norm_type <> 'prohibition'").select("row_ord")
    old = M.side(members.join(lost, "row_ord"), "a", "row_ord", *more).withColumnRenamed("a_row_ord", "row_ord")
    old = materialize(old, "lost-members")
    pairs = nearest_pairs(old, M.side(members.where("period = 'after'"), "b", *more))
    none = old.join(pairs.select("a_ord").distinct(), "a_ord", "left_anti")
    pairs = pairs.unionByName(none, allowMissingColumns=True)
    covers = F.size(F.array_intersect("a_a", "b_a"))
    part = (F.col("a_norm_type") == F.col("b_norm_type")) & (F.col("object") >= 0.35) & (F.col("s") >= 0.30)
    by = pairs.groupBy("row_ord", "a_ord").agg(
        F.coalesce(F.max(F.when(F.col("a_norm_type") == F.col("b_norm_type"), F.col("support"))), F.lit(0.0)).alias("strongest"), F.first("a_owner_known").alias("known"),
        F.coalesce(F.bool_or((F.col("a_unit") != F.col("b_unit")) & F.col("b_owner_known") & (F.col("support") >= 0.55)), F.lit(False)).alias("transfer"),
        F.count_distinct(F.when(part, F.col("b_frag_id"))).alias("sources"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(part & (covers > 0), F.array_intersect("a_a", "b_a")))))).alias("covered"),
    )
    one = by.groupBy("row_ord").agg(F.max("strongest").alias("strongest"), F.bool_and("known").alias("known"), F.bool_or("transfer").alias("transfer"), F.bool_or((F.col("sources") >= 2) & (F.col("covered") >= 2)).alias("parts"))
    lit = {k: F.lit(v) for k, v in state.items()}
    score = S.loss_score(F.col("strongest"), F.col("known"), lit["ratio"], F.lit(True), lit["complete"], lit["clean"], F.lit(state["unknown"] > 0), F.col("transfer") | F.col("parts"), F.lit(state["n"] == 0))
    return one.select("row_ord", F.round("strongest", 4).alias("strongest"), "transfer", "parts", score.alias("score"))


def match_scores(rows: DataFrame, members: DataFrame, state: dict) -> DataFrame:
    """row_ord, coverage, score of matched rows: the mean of the best support of each member, both ways."""
    pairs = _pair_signals(_pairs(members, "before", "after"))
    both = [pairs.groupBy("row_ord", F.col(f"{p}_ord").alias("o")).agg(F.max("support").alias("best")) for p in "ab"]
    coverage = both[0].union(both[1]).groupBy("row_ord").agg(F.avg("best").alias("coverage"))
    known = members.groupBy("row_ord").agg(F.bool_and("owner_known").alias("known"), (F.count_distinct("norm_type") == 1).alias("one_norm"))
    out = rows.where("status in ('preserved', 'moved', 'changed')").join(coverage, "row_ord").join(known, "row_ord")
    score = S.match_score(F.col("coverage"), F.col("known").cast("double"), F.col("one_norm"), F.lit(state["clean"]), F.col("split"))
    return out.select("row_ord", F.round("coverage", 4).alias("coverage"), score.alias("score"))


def duplicate_findings(rows: DataFrame, members: DataFrame, state: dict) -> DataFrame:
    """row_ord, score: one duty of several departments whose scopes do not differ and which is not a general one."""
    over = rows.where(F.col("candidate_overlap") & (F.size("scopes") <= 1) & ~T.is_generic(F.col("label"))).select("row_ord")
    pairs = _pairs(members.join(over, "row_ord"), "after", "after").where("a_ord < b_ord and a_unit <> b_unit and a_owner_known and b_owner_known")
    best = Window.partitionBy("row_ord").orderBy(F.desc("support"), "a_ord", "b_ord")
    one = _pair_signals(pairs).withColumn("k", F.row_number().over(best)).where("k = 1")
    score = S.duplicate_score(F.col("s"), F.col("action"), F.col("object"), F.col("a_scope"), F.col("b_scope"), F.col("a_frag_id") == F.col("b_frag_id"), F.lit(state["clean"]))
    return one.select("row_ord", score.alias("score"))


def conflict_findings(assignments: DataFrame, state: dict) -> DataFrame:
    """unit, control_id, execute_id, score: a department controls what it executes."""
    late = ordered(assignments.where("package = 'after'"))
    found = M.conflicts(late.where(_department(F.col("unit"))))
    rows = M.prepared(late).select("fn_id", "t", "a", "scope")
    pairs = found.join(rows.select(F.col("fn_id").alias("execute_id"), *(F.col(c).alias(f"a_{c}") for c in ("t", "a", "scope"))), "execute_id")
    pairs = pairs.join(rows.select(F.col("fn_id").alias("control_id"), *(F.col(c).alias(f"b_{c}") for c in ("t", "a", "scope"))), "control_id")
    _, objects = S.signals(F.col("a_t"), F.col("a_a"), F.col("b_t"), F.col("b_a"))
    score = S.conflict_score(objects, F.lit(state["clean"]), F.col("a_scope"), F.col("b_scope"))
    return pairs.select("unit", "control_id", "execute_id", "objects", score.alias("score"))


def findings(assignments: DataFrame, rows: DataFrame, members: DataFrame, state: dict) -> DataFrame:
    """finding_no, kind, key, title, units, score, level: losses, then duplicates, then conflicts."""
    losses = loss_scores(rows, members, state).join(rows, "row_ord").select(F.lit("loss").alias("kind"), F.col("row_ord").alias("at"), F.col("row_id").alias("key"), F.when(F.col("norm_type") == "right", "right_not_found").otherwise("owner_not_found").alias("title"), F.col("owners_before").alias("units"), "score")
    doubles = duplicate_findings(rows, members, state).join(rows, "row_ord").select(F.lit("duplicate").alias("kind"), F.col("row_ord").alias("at"), F.col("row_id").alias("key"), F.lit("overlap").alias("title"), F.col("owners_after").alias("units"), "score")
    order = ordered(assignments).select(F.col("fn_id").alias("execute_id"), F.col("fn_ord").alias("at"))
    clashes = conflict_findings(assignments, state).join(order, "execute_id").select(F.lit("conflict").alias("kind"), "at", F.concat_ws("|", "execute_id", "control_id").alias("key"), F.lit("execution_and_control").alias("title"), F.array("unit").alias("units"), "score")
    every = losses.unionByName(doubles).unionByName(clashes)
    place = F.array_position(F.array(F.lit("loss"), F.lit("duplicate"), F.lit("conflict")), F.col("kind"))
    every = numbered(every, place, "at", "key", name="finding_no")
    return every.select("finding_no", "kind", "key", "title", "units", "score", band(F.col("score")).alias("level"))


def unit_changes(scanned_units: DataFrame, assignments: DataFrame) -> DataFrame:
    """before, after, score, status of units(package, unit): by names and by how well their duties cover each other.

    Only pairs that share a word of the name or a linked duty can match, so no other pair is made.
    """
    rows = M.prepared(ordered(assignments))
    links = M.member_edges(rows, M.edges(rows, 0.0)).withColumnsRenamed({"x": "a_ord", "y": "b_ord"})
    unit_of = rows.select("fn_ord", "unit", "period")
    pair = links.join(unit_of.where("period = 'after'").select(F.col("fn_ord").alias("a_ord"), F.col("unit").alias("after")), "a_ord")
    pair = pair.join(unit_of.where("period = 'before'").select(F.col("fn_ord").alias("b_ord"), F.col("unit").alias("before")), "b_ord")
    size = unit_of.groupBy("period", "unit").agg(F.count("*").alias("n"))

    def cover(own: str, side: str) -> DataFrame:
        best = pair.groupBy("before", "after", own).agg(F.max("s").alias("s")).groupBy("before", "after").agg(F.sum("s").alias("sum"))
        n = size.where(F.col("period") == side).select(F.col("unit").alias(side), F.col("n").alias(f"n_{side}"))
        return best.join(n, side).select("before", "after", (F.col("sum") / F.col(f"n_{side}")).alias(f"by_{side}"), f"n_{side}")

    profile = cover("b_ord", "before").join(cover("a_ord", "after"), ["before", "after"])
    profile = profile.select("before", "after", ((F.col("by_before") + F.col("by_after")) / 2).alias("profile"), F.least("n_before", "n_after").alias("duties"))
    names = scanned_units.select("package", "unit", T.norm(F.col("unit")).alias("n"), T.tokens(F.col("unit")).alias("t"))
    old = names.where("package = 'before'").select(F.col("unit").alias("before"), F.col("n").alias("a_n"), F.col("t").alias("a_t"))
    new = names.where("package = 'after'").select(F.col("unit").alias("after"), F.col("n").alias("b_n"), F.col("t").alias("b_t"))
    shared = old.select("before", F.explode("a_t").alias("w")).join(new.select("after", F.explode("b_t").alias("w")), "w").select("before", "after")
    able = shared.union(profile.select("before", "after")).distinct().join(old, "before").join(new, "after").join(profile, ["before", "after"], "left")
    able = able.select("before", "after", T.similarity(F.col("a_n"), F.col("b_n"), F.col("a_t"), F.col("b_t")).alias("name"), F.coalesce("profile", F.lit(0.0)).alias("profile"), F.coalesce("duties", F.lit(0)).alias("duties"), (F.col("a_n") == F.col("b_n")).alias("same"))
    changes = S.match_units(able, old.select(F.col("before").alias("unit")), new.select(F.col("after").alias("unit")))
    return changes.withColumn("score", F.round("score", 2))


def cells(rows: DataFrame, members: DataFrame, present: DataFrame) -> DataFrame:
    """row_ord, unit, side, outcome, marker: the eleven outcomes of a matrix cell, for every row and unit and either side.

    present: unit, side of the units that an edition lists. The grid is the matrix itself.
    """
    role = F.create_map(*(F.lit(x) for kv in MARKERS.items() for x in kv))
    at = members.groupBy("row_ord", "unit", F.col("period").alias("side")).agg(F.array_join(_sorted_set(F.coalesce(role[F.col("role")], F.lit("?"))), "/").alias("marker"), F.bool_and("owner_known").alias("known"))
    row = members.groupBy("row_ord").agg(F.count_if(F.col("period") == "before").alias("n_before"), F.count_if(F.col("period") == "after").alias("n_after"), F.bool_and(F.col("owner_known") | (F.col("period") != "before")).alias("old_known"))
    every = members.select("unit").union(present.select("unit")).distinct()
    grid = rows.select("row_ord", "status", "candidate_overlap").withColumn("_all", F.lit(0)).join(every.withColumn("_all", F.lit(0)), "_all").withColumn("side", F.explode(F.array(F.lit("before"), F.lit("after")))).drop("_all")
    other = at.select("row_ord", "unit", F.when(F.col("side") == "before", "after").otherwise("before").alias("side"), F.lit(True).alias("elsewhere"))
    listed = present.select("unit", "side", F.lit(True).alias("listed")).distinct()
    full = grid.join(at, ["row_ord", "unit", "side"], "left").join(other, ["row_ord", "unit", "side"], "left").join(listed, ["unit", "side"], "left").join(row, "row_ord")
    here, was, late = F.col("marker").isNotNull(), F.coalesce("elsewhere", F.lit(False)), F.col("side") == "after"
    none = F.when(late, F.col("n_after")).otherwise(F.col("n_before")) == 0
    status = F.col("status")
    outcome = (
        F.when(here & ~F.col("known"), "owner_unclear").when(here & late & ~was, "added").when(here & late & F.col("candidate_overlap"), "overlap").when(here & late & (status == "changed"), "reworded")
        .when(here, "present").when(late & was & (status == "unknown"), "not_enough_data").when(late & was & (status == "lost") & F.col("old_known"), "missing").when(late & was, "moved_away")
        .when(F.col("listed").isNull(), "not_listed").when((status == "unknown") & none, "no_data").otherwise("none")
    )
    return full.select("row_ord", "unit", "side", outcome.alias("outcome"), F.coalesce("marker", F.lit("")).alias("marker"))


def export_rows(rows: DataFrame, members: DataFrame) -> DataFrame:
    """One row an assignment of the matrix, rows by review priority: status, then rows of general owners only."""
    general = F.col("unit").startswith("Главный аудитор") | F.col("unit").startswith("БВА") | F.col("unit").startswith(ROLE) | F.col("unit").startswith(UNKNOWN)
    only = members.groupBy("row_ord").agg(F.bool_and(general).alias("general_only"))
    place = F.array_position(F.array(*(F.lit(x) for x in ("moved", "changed", "lost", "new", "unknown", "preserved"))), F.col("status"))
    return rows.join(only, "row_ord").join(members.select("row_ord", "period", "unit", "text", "role", "scope", "owner_known", "frag_id", "fn_ord"), "row_ord").select("row_id", "status", place.alias("priority"), "general_only", "label", "norm_type", "period", "unit", "text", "role", "scope", "owner_known", "frag_id", "fn_ord")


def overview(rows: DataFrame, found: DataFrame, changes: DataFrame) -> DataFrame:
    """name, value: counts of statuses of rows and units, and of findings by kind."""
    a = rows.groupBy(F.concat(F.lit("row_"), "status").alias("name")).agg(F.count("*").alias("value"))
    b = changes.groupBy(F.concat(F.lit("unit_"), "status").alias("name")).agg(F.count("*").alias("value"))
    return a.union(b).union(found.groupBy(F.concat(F.lit("finding_"), "kind").alias("name")).agg(F.count("*").alias("value")))
