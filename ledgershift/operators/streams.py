"""Rollups of an event stream: day buckets under a watermark, kept as a log of changes in which a revised key is retracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def day_buckets(events: DataFrame, watermark: str, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """day, keys, n, total of events(ts timestamp, value, keys), streaming or not; a day is one of UTC. On a stream, rows later than the watermark are dropped."""
    held = events.withWatermark("ts", watermark) if events.isStreaming else events
    return held.groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("day"), *keys, "n", "total")


def roll(spark: SparkSession, stream: DataFrame, watermark: str, keys: tuple[str, ...] = ("event_type",), log: str | None = None) -> DataFrame:
    """Run a bounded stream to its end and return the log: batch, sign, day, keys, n, total.

    Each micro-batch gives the buckets that it changed. A bucket that stood already is retracted (sign -1) and given anew
    (sign 1), so that sums of sign times value are right at any moment, and the rows of one batch can be read twice or
    written again: a batch is a folder of its own. The state is one row a bucket.
    """
    path = log or scratch_path(spark, "stream-log")
    names = ["day", *keys]
    schema = day_buckets(stream, watermark, keys).schema.simpleString()[7:-1].replace(":", " ")

    def write(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        before = latest(session.read.schema(f"sign int, {schema}, batch long").parquet(path).where(F.col("batch") < batch), names) if batch else None
        new = rows.select(F.lit(1).alias("sign"), *rows.columns)
        if before is not None:
            same = before.join(rows.select(*names), names, "left_semi").select(F.lit(-1).alias("sign"), *rows.columns)
            new = new.unionByName(same)
        new.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = day_buckets(stream, watermark, keys).writeStream.outputMode("update").option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(f"sign int, {schema}, batch long").parquet(path)


def latest(log: DataFrame, names: list[str]) -> DataFrame:
    """The buckets that stand: the newest row of each that is not retracted."""
    last = Window.partitionBy(*names).orderBy(F.desc("batch"), F.desc("sign"))
    return log.withColumn("__k", F.row_number().over(last)).where("__k = 1 and sign = 1").drop("__k", "sign", "batch")


def net(log: DataFrame, names: list[str]) -> DataFrame:
    """The buckets that stand, from the sums of what was given and retracted."""
    return log.groupBy(*names).agg(F.sum(F.col("sign") * F.col("n")).alias("n"), F.sum(F.col("sign") * F.col("total")).alias("total")).where("n > 0")
