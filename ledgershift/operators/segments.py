"""Values that hold from the row that sets them until a row that takes them back, in order, within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, by: list[str], order: list[str], sets: Column, value: Column, resets: Column, name: str) -> DataFrame:
    """rows with `name`: `value` of the last row that set it, null before any and from a reset on; a row that does both sets.

    A running count of the rows that set or reset numbers the segments; a segment's first row gives its value. Null
    conditions do nothing. One exchange by `by`; a group is sorted, and read as a stream.
    """
    sets, resets = F.coalesce(sets, F.lit(False)), F.coalesce(resets, F.lit(False))
    line = Window.partitionBy(*by).orderBy(*order)
    counted = rows.withColumn("__segment", F.sum((sets | resets).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.when(sets, value)).over(Window.partitionBy(*by, "__segment").orderBy(*order))
    return counted.withColumn(name, F.when(F.col("__segment") > 0, first)).drop("__segment")
