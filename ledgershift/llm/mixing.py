"""Time-varying curriculum: mix sources to target weights and give every taken word a training position.

Targets: shares of `share` times all words by weight, stopped at `most` times a source's size, the excess reshared
(water filling: the level is found in one ordered pass over sources). A source's stream runs over its documents in the
order of a hash, epoch after epoch, and ends at the target; so at most one document of a source is taken in part.
Positions: source s has a weight schedule that falls or rises in a line from a to b over training; its integral is the
cumulative demand, and the inverse of that gives the time at which a word of the stream is due. Documents are sorted by
that position with a range partitioning.

Scale: running sums are in three levels, parts of a source, their hash buckets, and documents in a bucket, so a source of
a third of all rows is spread over tens of thousands of keys, and no window holds more than 256 sums. Rows carry their columns through the running sum, so repeated rows have
places of their own and nothing is joined back. Rows without a position are sorted by a hash behind those with one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count, words

#: Weights of sources by code point, repeating; what is shared, in words of all; the most a source gives, in its own words.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Schedules (weight at the start, at the end) that go with the weights: heavy sources early, light ones late.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, weight_no, target) for each source of sized(skey, size); skey orders sources, null last."""
    by = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("weight_no", (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights))
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("weight_no") + 1))
    filled = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "skey")
    by = by.withColumn("full_before", F.coalesce(F.sum(F.col("source_size") * most).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("weight_left", F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.sum("source_size").over(everyone) * F.lit(share) - F.col("full_before")) / F.col("weight_left"))
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * most
    by = by.withColumn("level", F.max(F.when(fits, F.col("level"))).over(everyone))
    target = F.least(F.col("source_size") * F.lit(float(most)), F.coalesce(F.col("level") * F.col("weight"), F.col("source_size") * F.lit(float(most))))
    return by.select("skey", "source_size", F.col("weight_no").cast("int").alias("weight_no"), target.alias("target"))


def _position(at, schedules):
    """When a share `at` of a source's demand has been met: the inverse of the integrated linear schedule."""
    a, b = (F.element_at(F.array(*(F.lit(float(s[i])) for s in schedules)), F.col("weight_no") + 1) for i in (0, 1))
    return F.when(a == b, at).otherwise((F.sqrt(a * a + (b * b - a * a) * at) - a) / F.when(a != b, b - a))


def _plan(docs: DataFrame, weights, share: float, most: int, schedules) -> DataFrame:
    """docs' columns, as a struct `_row`, with the columns of mix_plan."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    key = F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("skey"), word_count(text).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), text, F.lit(""))).alias("h"))
    rows = rows.withColumn("bucket", F.substring("h", 1, 4))
    sums = materialize(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    targets = materialize(source_targets(sums, weights, share, most), "mix-targets")
    sums = sums.withColumn("part", F.substring("bucket", 1, 2))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("skey", "part").agg(F.sum("size").alias("size"))
    parts = parts.select("skey", "part", F.coalesce(F.sum("size").over(before("skey", "part")), F.lit(0)).alias("part_before"))
    sums = sums.withColumn("in_part", F.coalesce(F.sum("size").over(before("skey", "part", "bucket")), F.lit(0)))
    sums = sums.join(parts, ["skey", "part"]).select("skey", "bucket", (F.col("part_before") + F.col("in_part")).alias("bucket_before"))
    within = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(sums, ["skey", "bucket"]).join(F.broadcast(targets) if _few(targets) else targets, "skey")
    start, demand = F.col("bucket_before") + F.col("before"), F.floor("target")
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), demand - F.col("source_size") * e - start)).cast("long") for e in range(most)]
    rows = rows.withColumn("takes", F.array(*takes))
    at = [F.when(F.col("takes")[e] > 0, _position((F.col("source_size") * e + start + F.col("takes")[e] / 2) / F.col("target"), schedules)) for e in range(most)]
    return rows.select("_row", "doc_id", "size", "source_size", "target", "h", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), "takes", F.array(*at).alias("positions"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """For each row of docs(doc_id long, source string, text string, ...): doc_id, size, source_size, target, taken, position, again_position.

    position, again_position: when in training (0..1) the document is due, the first time and in the second pass over its
    source; null where nothing is taken. Null or empty text: size 0, nothing taken. Null source: a source of its own, the
    last. A null doc_id takes its place by its text. Ties in the hash order (repeated rows) go by size; such rows are
    taken each. All sizes 0: targets 0. Empty tables: no row. Other columns are not read. Sorted by position (range
    partitioning), untaken rows last.
    """
    rows = _plan(docs.select("doc_id", "source", "text"), weights, share, most, schedules).drop("_row")
    rows = rows.withColumn("position", F.col("positions")[0]).withColumn("again_position", F.col("positions")[1] if most > 1 else F.lit(None).cast("double"))
    late = F.lit(1.5) + F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2**33
    return rows.orderBy(F.coalesce("position", late)).select("doc_id", "size", "source_size", "target", "taken", "position", "again_position")


def _few(targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources is small enough to send to every task (its rows are a few dozen bytes)."""
    return targets.limit(most + 1).count() <= most


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """docs' columns, a row for each time a document is taken, sorted by training position; one taken in part keeps its first words.

    n_chars, where docs has it, follows the text. Nulls, ties and repeated rows as in mix_plan: each repeated row is
    taken by itself, so the words of the result are those of the plan. Columns of any other name pass through.
    """
    rows = _plan(docs, weights, share, most, schedules).where("taken > 0")
    rows = rows.select("_row", "size", F.explode(F.arrays_zip("takes", "positions")).alias("_p")).where("_p.takes > 0")
    text, take = F.col("_row.text").cast("string"), F.col("_p.takes")
    cut = F.when(take < F.col("size"), F.array_join(F.slice(words(text), 1, F.greatest(F.lit(1), take.cast("int"))), " ")).otherwise(text)
    new = {"text": cut} | ({"n_chars": F.length(cut).cast("long")} if "n_chars" in docs.columns else {})
    return rows.orderBy("_p.positions").select(*(new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns))
