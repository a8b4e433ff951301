"""Conversation structure repair: the cheapest edits that give turns the shape (s?(ua)+)?, by dynamic programming.

State: start, after system, after user, after assistant. Backward, each turn gets the cost to go from each state; forward,
a walk takes the ASCII-least edit among those that keep the cost. Turns are rebuilt from the walk.

Scale: rows are summed to distinct (conversation, turn, role, text) with a number of copies, then dealt by range in that
order, so that a conversation of any length is spread over the partitions. A conversation inside one partition is done
there. One that a partition's edge cuts is done by pieces: a piece's costs to go from each state to each state are a
matrix; products of the later pieces' matrices give each piece the costs behind it; its walks from the four states give
the state in which each piece begins; then it is walked once. Only matrices and states of a conversation come together,
at most one of each a partition. The digest of the repaired turns is taken in a stream, as it is one of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, n_splits, ship

# Costs of the edits, pairs of initials that may follow each other, and faults in the order in which they count.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated")

START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> the role that may follow it besides a first system turn.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
END = (0, FAR, FAR, 0)

#: A turn as (role, text, fault or "", copies); a copy after the first of a turn without a text fault is a duplicate.
Turn = tuple[str, str, str, int]


def _steps(turns: list[Turn]) -> Iterator[tuple[str, str, str, int]]:
    """Turns with their copies apart: (role, text, fault, times); only forced deletions come several times."""
    for role, text, fault, copies in turns:
        if fault in ("blank", "duplicate"):
            yield role, text, fault, copies
        else:
            yield role, text, fault, 1
            if copies > 1:
                yield role, text, "duplicate", copies - 1


def _kept(initial: str, state: int) -> int:
    """The state after a kept turn, or -1."""
    if initial == "s":
        return SYSTEM if state == START else -1
    return NEXT[state] if initial == ("a" if NEXT[state] == ASSISTANT else "u") else -1


def _inserts(cost: list[int]) -> list[int]:
    """Costs to go, when turns may be inserted first."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    return cost


def costs_to_go(steps: list[tuple[str, str, str, int]], behind: tuple[int, ...] | list[int]) -> list[list[int]]:
    """Backward: before each step and after the last, the least cost from each state, given that behind the last."""
    out = [_inserts(list(behind))]
    for role, _, fault, times in reversed(steps):
        after, now = out[-1], []
        for s in range(4):
            best = DELETE * times + after[s]
            if fault not in ("blank", "duplicate"):
                extra = TRUNCATED if fault else 0
                best = min(best, REROLE + extra + after[NEXT[s]])
                if (to := _kept(role[:1], s)) >= 0:
                    best = min(best, KEEP + extra + after[to])
            now.append(best)
        out.append(_inserts(now))
    return out[::-1]


def walk(steps: list[tuple[str, str, str, int]], cost: list[list[int]], state: int, last: bool) -> tuple[str, list[tuple[str, str]], int]:
    """Forward: (edits' initials, repaired turns, state at the end), the ASCII-least edit first: D, I, K, R."""
    audit, out, i = [], [], 0
    while i < len(steps) or last:
        due = cost[i][state]
        if i < len(steps):
            role, text, fault, times = steps[i]
            if DELETE * times + cost[i + 1][state] == due:
                audit.append("D" * times)
                i += 1
                continue
        elif due == 0 and END[state] == 0:
            break
        to = NEXT[state]
        if INSERT + cost[i][to] == due:
            audit.append("I")
            out.append((NAMES[to], ""))
            state = to
            continue
        extra, own = (TRUNCATED if fault else 0), _kept(role[:1], state)
        if own >= 0 and KEEP + extra + cost[i + 1][own] == due:
            audit.append("K")
            out.append((role, text))
            state = own
        else:
            audit.append("R")
            out.append((NAMES[to], text))
            state = to
        i += 1
    return "".join(audit), out, state


def _illegal(turns: list[Turn], before: str | None) -> int:
    """Pairs of neighbours that may not follow each other, with the initial before the first; copies are neighbours."""
    n = 0
    for role, _, _, copies in turns:
        initial = role[:1]
        n += (before is not None and before + initial not in LEGAL) + (copies - 1) * (initial * 2 not in LEGAL)
        before = initial
    return n


def _repaired(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


_PIECE = [("conv_id", T.LongType()), ("piece", T.IntegerType())]
_TURNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if n == "copies" else T.StringType()) for n in ("role", "text", "fault", "copies")]))
_ONE = T.StructType(
    [T.StructField(n, t) for n, t in [*_PIECE, ("done", T.BooleanType()), ("illegal", T.LongType()), ("initials", T.StringType()), ("matrix", T.ArrayType(T.LongType())), ("turns", _TURNS), ("cost", T.LongType()), ("audit", T.StringType()), ("sha", T.StringType())]]
)
_CHAIN = T.StructType([T.StructField(n, t) for n, t in [*_PIECE, ("behind", T.ArrayType(T.LongType())), ("seam", T.LongType()), ("all", T.LongType())]])
_EXITS = T.StructType([T.StructField(n, t) for n, t in [*_PIECE, ("exits", T.ArrayType(T.IntegerType()))]])
_ENTRY = T.StructType([T.StructField(n, t) for n, t in [*_PIECE, ("entry", T.IntegerType()), ("last", T.BooleanType())]])
_WALKED = T.StructType([T.StructField(n, t) for n, t in [*_PIECE, ("audit", T.StringType()), ("repaired", T.StringType())]])
_DIGEST = T.StructType([T.StructField(n, t) for n, t in [("conv_id", T.LongType()), ("audit", T.StringType()), ("sha", T.StringType())]])


def _batches(rows: Iterator[tuple], schema: T.StructType, at_most: int = 2048) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(dict(zip(schema.names, row, strict=True)))
        if len(held) == at_most:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kinds)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, 2048):
            yield from b.slice(k, 2048).to_pylist()


def _first_pass(batches: Iterator[pa.RecordBatch], sure: bool) -> Iterator[pa.RecordBatch]:
    """Sorted turns -> a row for each conversation, done; the first and the last of a partition as pieces, unless it is the only one (`sure`)."""

    def rows() -> Iterator[tuple]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for conv, group in groupby(_stream(batches), key=lambda r: r["conv_id"]):
            turns = [(r["role"], r["text"], r["fault"], r["copies"]) for r in group]
            if held:
                yield _one(*held, part, sure or not first)
                first = False
            held = (conv, turns)
        if held:
            yield _one(*held, part, sure)

    return _batches(rows(), _ONE)


def _one(conv: int | None, turns: list[Turn], part: int, whole: bool) -> tuple:
    steps, inside = list(_steps(turns)), _illegal(turns, None)
    if whole:
        cost = costs_to_go(steps, END)
        audit, out, _ = walk(steps, cost, START, True)
        return conv, part, True, inside, "", [], [], cost[0][START], audit, hashlib.sha256(_repaired(out).encode()).hexdigest()
    by_end = [costs_to_go(steps, [0 if s == to else FAR for s in range(4)])[0] for to in range(4)]
    matrix = [min(by_end[to][s], FAR) for s in range(4) for to in range(4)]
    named = [dict(zip(("role", "text", "fault", "copies"), t, strict=True)) for t in turns]
    return conv, part, False, inside, f"{turns[0][0][:1] or ' '}{turns[-1][0][:1] or ' '}", matrix, named, None, None, None


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrices of a conversation's pieces -> for each the costs behind it, the illegal pair at its seam, and the whole cost."""

    def rows() -> Iterator[tuple]:
        for r in _stream(batches):
            pieces, behind, out = r["pieces"], list(END), []
            for p in reversed(pieces):
                out.append((p["piece"], _inserts(behind)))
                m = p["matrix"]
                behind = [min(min(m[4 * s + to] + behind[to] for to in range(4)), FAR) for s in range(4)]
            ends = [None, *(p["initials"][1] for p in pieces)]
            for (piece, costs), p, end in zip(reversed(out), pieces, ends, strict=False):
                yield r["conv_id"], piece, costs, int(end is not None and end + p["initials"][0] not in LEGAL), behind[START]

    return _batches(rows(), _CHAIN)


def _plain(turns: list[dict]) -> list[tuple[str, str, str, int]]:
    return list(_steps([(t["role"], t["text"], t["fault"], t["copies"]) for t in turns]))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the walks through a piece end, from each state."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                steps = _plain(r["turns"])
                cost = costs_to_go(steps, r["behind"])
                yield r["conv_id"], r["piece"], [walk(steps, cost, s, False)[2] if cost[0][s] < FAR else s for s in range(4)]

    return _batches(rows(), _EXITS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each piece of a conversation begins, and whether it is the last."""

    def rows() -> Iterator[tuple]:
        for r in _stream(batches):
            state = START
            for k, p in enumerate(r["pieces"]):
                yield r["conv_id"], p["piece"], state, k == len(r["pieces"]) - 1
                state = p["exits"][state]

    return _batches(rows(), _ENTRY)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            for k in range(b.num_rows):
                (r,) = b.slice(k, 1).to_pylist()
                steps = _plain(r["turns"])
                audit, out, _ = walk(steps, costs_to_go(steps, r["behind"]), r["entry"], r["last"])
                yield r["conv_id"], r["piece"], audit, _repaired(out) if out else None

    return _batches(rows(), _WALKED, 1)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> whole audits and digests; one piece's text is held at a time."""

    def single() -> Iterator[dict]:
        for b in batches:
            for k in range(b.num_rows):
                yield from b.slice(k, 1).to_pylist()

    def rows() -> Iterator[tuple]:
        for conv, group in groupby(single(), key=lambda r: r["conv_id"]):
            sha, audit, some = hashlib.sha256(), [], False
            for r in group:
                audit.append(r["audit"])
                if r["repaired"] is not None:
                    sha.update((("\n" if some else "") + r["repaired"]).encode())
                    some = True
            yield conv, "".join(audit), sha.hexdigest()

    return _batches(rows(), _DIGEST, 1)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted damage by crc32(`conv_id:turn`) % 20, and `copies`, the times a row stands.

    0: no copy, 1: empty text, 2: text without `[.!?]`, 3: two copies, 4: role user. A null conv_id or turn is one space
    in the key, a null role or text one space; conv_id and turn stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "utf-8")) % 20
    text, role = space("text"), space("role")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _fault(text: Column) -> Column:
    """blank, truncated or nothing, by the text alone."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")


def repair(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Faults and cheapest repair of each conversation of rows(conv_id long, turn long, role, text, copies long, ...).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. `copies`, if it is there, is how
    often a row stands; a conversation whose rows stand no time has zeros, no edit and the digest of nothing.

    Turns go by number, nulls first, equal ones by role, then text. A null role or text is one space; a null conv_id is a
    conversation. A row whose role and text stood earlier is a duplicate, repeated rows too. Texts of any length are
    whole. gaps is null where it exceeds a long. Other columns are not read. An empty table gives no row. parts:
    partitions of the range exchange (default: shuffle partitions or twice the input's splits).
    """
    ship(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), copies.alias("copies"))
    one = given.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    one = materialize(one.withColumns({"fault": _fault(F.col("text")), "same": F.sha2(key, 256)}), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = one.groupBy("conv_id", "same").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialize(again.select(F.col("conv_id").alias("_c"), F.col("same").alias("_s"), "first"), "said-again")
    turns = one.join(again, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("same") == F.col("_s")), "left")
    late = F.col("first").isNotNull() & (order != F.col("first")) & (F.col("fault") != "blank")
    turns = turns.select("conv_id", "turn", "role", "text", F.when(late, "duplicate").otherwise(F.col("fault")).alias("fault"), "copies")

    # the faults of a row that stands several times: the first one's own, duplicates after it unless blank
    as_own = lambda f: F.when(F.col("fault") == f, F.when(F.col("fault").isin("blank", "duplicate"), F.col("copies")).otherwise(1)).otherwise(0)
    more = F.when(F.col("fault").isin("truncated", ""), F.col("copies") - 1).otherwise(0)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    counts = turns.groupBy("conv_id", "turn").agg(F.sum(as_own("blank")).alias("blank"), F.sum(as_own("duplicate") + more).alias("duplicate"), F.sum(as_own("truncated")).alias("truncated"))
    gaps = F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count("turn")
    counts = counts.groupBy("conv_id").agg(F.when(F.count("turn") > 0, gaps.try_cast("long")).otherwise(0).alias("gaps"), *(F.sum(f).alias(f) for f in FAULTS))

    n = parts or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * n_splits(one))
    dealt = turns.repartitionByRange(n, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    dealt = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text", "fault", "copies")
    first = materialize(dealt.mapInArrow(partial(_first_pass, sure=n == 1), _ONE), "conversations")
    done = first.where("done").select("conv_id", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    fixed = done.unionByName(_by_pieces(first.where(~F.col("done"))))

    both = counts.join(fixed.withColumnRenamed("conv_id", "_f"), F.col("conv_id").eqNullSafe(F.col("_f"))).drop("_f")
    every = given.groupBy("conv_id").agg(F.lit(1).alias("one")).select(F.col("conv_id").alias("_k"))
    out = every.join(both, F.col("_k").eqNullSafe(F.col("conv_id")), "left")
    some = F.col("cost").isNotNull()
    zero = lambda c: F.when(some, F.col(c)).otherwise(0).cast("long").alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_k").alias("conv_id"), zero("gaps"), *(zero(f) for f in FAULTS), zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _by_pieces(pieces: DataFrame) -> DataFrame:
    """Conversations that partitions cut: costs behind each piece, states between them, then one walk through each."""
    slim = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "initials", "matrix"))).alias("pieces"), F.sum("illegal").alias("illegal"))
    chain = materialize(slim.select("conv_id", "pieces").mapInArrow(_chained, _CHAIN), "costs-behind")
    known = _with(pieces.select("conv_id", "piece", "turns"), chain, "behind")
    exits = known.mapInArrow(_exits, _EXITS).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "exits"))).alias("pieces"))
    entries = materialize(exits.mapInArrow(_entries, _ENTRY), "states")
    walked = _with(known, entries, "entry", "last").mapInArrow(_walked, _WALKED)
    whole = walked.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "piece").mapInArrow(_digested, _DIGEST)
    sums = chain.groupBy(F.col("conv_id").alias("_a")).agg(F.sum("seam").alias("seam"), F.max("all").alias("cost"))
    out = slim.select(F.col("conv_id").alias("_b"), "illegal").join(sums, F.col("_a").eqNullSafe(F.col("_b")))
    out = whole.join(out, F.col("conv_id").eqNullSafe(F.col("_a")))
    return out.select("conv_id", (F.col("illegal") + F.col("seam")).alias("illegal"), "cost", "audit", F.col("sha").alias("repaired_sha256"))


def _with(pieces: DataFrame, more: DataFrame, *columns: str) -> DataFrame:
    """pieces with columns of the same piece: a piece holds about a partition's rows, its columns a few numbers."""
    named = more.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), *columns)
    return pieces.join(named, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p"))).drop("_c", "_p")
