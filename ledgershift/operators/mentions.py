"""Which names of a catalogue stand in a text, as whole words.

A catalogue of a known, small size becomes one automaton that reads each text once, whatever the number of names; it is
sent to the tasks only after its size is checked. A larger one is met by a join: word sequences of the names' lengths,
hashed, against the names. Both test the characters beside an occurrence, and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship

#: Characters of all names together, and names, up to which a catalogue is sent to every task.
MOST_CHARS, MOST_NAMES = 4_000_000, 100_000
WORDS = r"(?U)\w+"

_AUTOMATA: dict[int, object] = {}


def _automaton(sent: Broadcast):
    """needle -> [(key, id)], once a worker."""
    import ahocorasick

    if id(sent.value) in _AUTOMATA:
        return _AUTOMATA[id(sent.value)][0]
    owners: dict[str, list] = {}
    for key, ident, needle in sent.value:
        owners.setdefault(needle, []).append((key, ident))
    out = ahocorasick.Automaton()
    for needle, who in owners.items():
        out.add_word(needle, (len(needle), who))
    out.make_automaton()
    _AUTOMATA.clear()
    _AUTOMATA[id(sent.value)] = (out, sent.value)  # the value is kept, so that its id stays its own
    return out


def _word_char(c: str) -> bool:
    return c.isalnum() or c == "_"


def _search(batches: Iterator[pa.RecordBatch], sent: Broadcast, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    automaton = _automaton(sent)
    for batch in batches:
        found = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids: set[int] = set()
            for last, (size, who) in automaton.iter(text) if text and len(automaton) else ():
                a, b = last - size + 1, last + 1
                if (a == 0 or not _word_char(text[a - 1])) and (b == len(text) or not _word_char(text[b])):
                    ids.update(ident for k, ident in who if k == key)
            found.append(sorted(ids))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int64()))], schema=schema)


def _grams(words: Column, n: Column) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.struct(n.alias("n"), F.xxhash64(F.slice(words, i, n)).alias("h"))))


def _by_join(texts: DataFrame, names: DataFrame) -> DataFrame:
    words = F.regexp_extract_all("needle", F.lit(WORDS), 0)
    keyed = names.select("key", "id", "needle", F.size(words).alias("n"), F.xxhash64(words).alias("h")).where("n > 0")
    lengths = keyed.groupBy("key").agg(F.collect_set("n").alias("lengths"))  # by key: a few numbers
    said = texts.join(lengths, "key").withColumn("w", F.regexp_extract_all("text", F.lit(WORDS), 0))
    grams = F.array_distinct(F.flatten(F.filter(F.transform("lengths", lambda n: _grams(F.col("w"), n)), lambda g: g.isNotNull())))
    met = said.select("row", "key", "text", F.explode(grams).alias("g")).select("row", "key", "text", "g.n", "g.h").join(keyed, ["key", "n", "h"])
    quoted = F.concat(F.lit(r"(?U)(?<!\w)"), F.regexp_replace("needle", r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(r"(?!\w)"))
    return met.where(F.rlike("text", quoted)).groupBy("row").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def find_names(texts: DataFrame, names: DataFrame, most_chars: int = MOST_CHARS, most_names: int = MOST_NAMES) -> DataFrame:
    """(row, ids): for each of texts(row, key string, text) with a name of its key, the names' ids, ascending.

    names: key, id long, needle. An occurrence has no letter, digit or underscore beside it. Null texts, empty needles and
    empty tables give nothing. Equal needles of several ids give all of them; repeated texts of a row count once.
    """
    spark = texts.sparkSession
    ship(spark)
    names = materialize(names.select(F.col("key").cast("string").alias("key"), F.col("id").cast("long").alias("id"), "needle").where("needle is not null and needle <> ''"), "names")
    n, chars = names.agg(F.count("*"), F.coalesce(F.sum(F.length("needle")), F.lit(0))).first()
    texts = texts.select("row", F.col("key").cast("string").alias("key"), "text").where("text is not null")
    if n > most_names or chars > most_chars:
        return _by_join(texts, names)
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([T.StructField("row", texts.schema["row"].dataType), T.StructField("ids", T.ArrayType(T.LongType()))])
    sent = spark.sparkContext.broadcast([tuple(r) for r in names.collect()])  # at most most_names rows
    found = texts.mapInArrow(partial(_search, sent=sent, schema=to_arrow_schema(kind)), kind).where(F.size("ids") > 0)
    return found.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
