"""Chat formatting: records of different layouts become canonical turns by a fingerprint of their nested field paths.

A record's filled columns and their nested fields give a sorted list of paths; its hash selects a declarative mapping
(paths -> turns). Turns go through one template whose control strings are escaped inside texts, and get a loss mask over
assistant texts in runs (skip, keep) of characters. `read_back` takes the formatted text apart again.

Only DataFrame functions. A conversation is one row, as its digest needs; work in it is linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's marks, and control strings of common templates that texts may hold.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _java(text: str) -> str:
    return "".join("\\" + c if c in "\\[](){}.*+?^$|" else c for c in text)


_REST = "|".join(_java(c[1:]) for c in CONTROL)


def escape(text: Column) -> Column:
    """One backslash more after the first character of each control string, however many it has there."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def _role(role: Column) -> Column:
    r"""A role for the header line: backslash as \b and newline as \n, so that a backslash is always one of two letters' first; then control strings."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


@dataclass(frozen=True)
class Layout:
    """A mapping: the paths of a layout, and for each turn either (role, column) or the array that holds (role field, text field)."""

    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    array: str = ""
    fields: tuple[str, str] = ("", "")


#: Declarative mappings of known layouts; more can be passed.
LAYOUTS = (
    Layout(("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("completion", "prompt", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(("input", "instruction", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("messages[].content", "messages[].role"), array="messages", fields=("role", "content")),
    Layout(("conversations[].from", "conversations[].value"), array="conversations", fields=("from", "value")),
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}


def _some(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Whether any element of an array passes."""
    return lambda value: F.coalesce(F.exists(value, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _field(name: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda value: test(value.getField(name))


def _filled(name: str, kind: T.DataType) -> list[tuple[str, Callable[[Column], Column]]]:
    """(path, test of a value) for the nested field paths of a type. An array none of whose elements holds anything is filled as `name[]`."""
    if isinstance(kind, T.StructType):
        return [(p, _field(f.name, test)) for f in kind.fields for p, test in _filled(f"{name}.{f.name}", f.dataType)]
    if isinstance(kind, T.ArrayType):
        inside = [(p, _some(test)) for p, test in _filled(f"{name}[]", kind.elementType)]
        none = lambda value: value.isNotNull() & ~F.greatest(F.lit(False), *(test(value) for _, test in inside), F.lit(False))
        return [*inside, (f"{name}[]", none)] if inside[0][0] != f"{name}[]" else inside
    return [(name, lambda value: value.isNotNull())]


def field_paths(records: DataFrame, skip: tuple[str, ...]) -> Column:
    """The sorted nested field paths that a row fills, joined by a comma."""
    every = [(p, test(F.col(f"`{f.name}`"))) for f in records.schema.fields if f.name not in skip for p, test in _filled(f.name, f.dataType)]
    filled = [F.when(x, F.lit(p)) for p, x in sorted(every, key=lambda p: p[0])]
    return F.array_join(F.array_compact(F.array(*filled)), ",") if filled else F.lit("")


def _turn_of(role: str, text: str):
    """The canonical turn of an array's element; names of roles are translated in layouts that say `from`."""
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))

    def turn(x: Column) -> Column:
        r = F.coalesce(x[role].cast("string"), F.lit(""))
        return F.struct((F.coalesce(names[r], r) if role == "from" else r).alias("role"), F.coalesce(x[text].cast("string"), F.lit("")).alias("text"))

    return turn


def _mapping(layout: Layout, kinds: dict[str, T.DataType]) -> tuple[list[str], Column] | None:
    """Fingerprinted path lists that a layout takes, and its turns; None where the table has no such fields."""
    if not layout.array:
        if not set(layout.paths) <= set(kinds) or any(isinstance(kinds[c], (T.ArrayType, T.StructType, T.MapType)) for c in layout.paths):
            return None
        return [",".join(layout.paths)], F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"`{c}`").cast("string").alias("text")) for r, c in layout.turns))
    kind = kinds.get(layout.array)
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.StructType) or not set(layout.fields) <= set(kind.elementType.fieldNames()):
        return None
    return [",".join(layout.paths), *layout.paths, f"{layout.array}[]"], F.transform(F.col(layout.array), _turn_of(*layout.fields))


def canonical_turns(records: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """records(key, columns of any layouts) -> key, fingerprint long, turns array<struct<role, text>>; null turns where no mapping fits.

    A nested field counts as filled if any value of it is not null. Roles or texts that are null in an array, some or
    all, are empty; an empty array gives no turn. `keep` names columns that are no part of a layout; of the name
    fingerprint or turns, they are replaced. A column of a layout's name but another type fits no mapping. Repeated rows
    give repeated results. An empty table gives no row.
    """
    skip, keep = (key, *keep), tuple(c for c in keep if c not in ("fingerprint", "turns"))
    kinds = {f.name: f.dataType for f in records.schema.fields}
    own = F.xxhash64(field_paths(records, skip))
    known = F.lit(None).cast("array<struct<role:string,text:string>>")
    for found in (_mapping(x, kinds) for x in layouts):
        if found:
            known = F.when(own.isin(*(F.xxhash64(F.lit(p)) for p in found[0])), found[1]).otherwise(known)
    return records.select(key, *keep, own.alias("fingerprint"), known.alias("turns"))


def format_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """turns(key, turns) -> key, formatted string, loss_mask array<struct<skip, keep, rest>> (characters, one entry a turn).

    Null turns: no turn, an empty text. Empty texts and roles are turns. Repeated rows give repeated results; a null key
    stays null. Other columns are not read. An empty table gives no row. A text may be as long as a row can hold, all of a
    conversation being one row.
    """
    marked = F.transform(F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    rows = turns.select(key, marked.alias("m"))
    size = len(CLOSE)
    mask = F.transform("m", lambda t: F.struct(F.length(t["head"]).alias("skip"), F.when(t["loss"], F.length(t["body"])).otherwise(0).alias("keep"), F.when(t["loss"], size).otherwise(F.length(t["body"]) + size).alias("rest")))
    return rows.select(key, F.array_join(F.transform("m", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(chats: DataFrame, key: str = "conv_id") -> DataFrame:
    """formatted and loss_mask -> key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    An empty text has no turn, and the digests of nothing. Repeated rows give repeated results. Other columns are not read.
    """
    pieces = F.split("formatted", _java(CLOSE))
    rows = chats.select(key, F.length("formatted").cast("long").alias("formatted_chars"), F.slice(pieces, 1, F.size(pieces) - 1).alias("p"), "loss_mask")
    # a header is one line: what follows it is the text
    turn = F.transform("p", lambda x: F.concat(_role_back(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)), F.lit("\n"), unescape(F.regexp_replace(x, r"\A[^\n]*\n", "")), F.lit("\n")))
    loss = F.array_join(F.zip_with("p", "loss_mask", lambda x, m: F.when(m["keep"] > 0, unescape(F.substr(x, m["skip"] + 1, m["keep"]))).otherwise("")), "")
    rows = rows.select(key, "formatted_chars", F.size("p").cast("long").alias("n_turns"), F.array_join(turn, "").alias("t"), loss.alias("loss"))
    return rows.select(key, "n_turns", F.sha2("t", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id long, turn, role, text) by turn -> records (conv_id, messages); equal turns go by role, then text; null role or text: empty."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("m"))
    return grouped.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1#\2\3', 'g')) + length(role) + 24 AS f FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(f)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
