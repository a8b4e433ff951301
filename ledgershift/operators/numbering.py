"""Consecutive numbers over a whole table, without a task that sees all of it.

Rows are dealt by range and sorted; a row's number is its place in its partition plus the sizes of the partitions before.
One exchange; what comes together is one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: monotonically_increasing_id() holds the partition above this many bits, and the place in it below.
_PLACE = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "number", start: int = 1, parts: int | None = None) -> DataFrame:
    """df with `name`: start, start + 1, ... in the given order; ties in any order, but each its own number.

    Nulls go where the order puts them. An empty table stays empty. The result is a written table. Equal rows of the
    order are in one partition, so an order by a key of few values needs a further column to spread.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = materialize(dealt, "numbered")
    part = F.shiftright("__at", _PLACE)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__part", before.alias("__before"))
    place = F.col("__at").bitwiseAND((1 << _PLACE) - 1)
    return rows.withColumn("__part", part).join(F.broadcast(sizes), "__part").withColumn(name, (place + F.col("__before") + start).cast("long")).drop("__part", "__before", "__at")


def running_sums(df: DataFrame, by: list[str], order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the same `by` up to this one in order; `by` and `order` together tell rows apart.

    A key of any share of the rows is spread by range over its order; partitions' sums of a key, one row a partition,
    carry it across. Nulls of `by` are a key. The result reads a written table.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *by, *order).withColumn("__part", F.spark_partition_id())
    rows = materialize(dealt, "running-sums")
    own = F.sum(value).over(Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sizes = rows.groupBy("__part", *by).agg(F.sum(value).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__{c}") for c in by), before.alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.withColumn(name, own).join(sizes, same).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__p", "__before", *(f"__{c}" for c in by))
