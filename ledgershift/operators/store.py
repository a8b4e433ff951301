"""Runs on storage: stages that become visible together, and a table that a change set rewrites only where it must.

A run is written apart, with a manifest of its stages, and renamed into place last: a reader sees the newest whole run of
its namespace or the one before, never half of one. Paths are opened by Hadoop's file systems only.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

PLAIN = r"[a-zA-Z0-9_-]{1,100}"
_MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _guarded(rows: DataFrame) -> DataFrame:
    """rows whose write fails at a number that is none: NaN or infinite."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    fields = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return rows.withColumns({n: F.when(bad(F.col(f"`{n}`")), F.raise_error(F.lit(f"{n} is not finite"))).otherwise(F.col(f"`{n}`")) for n in fields})


def _attempts(spark: SparkSession, root: str, run_id: str) -> list[int]:
    fs, p = _fs(spark, f"{root}/run_id={run_id}")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = sorted(int(n[2:]) for n in names if re.fullmatch(r"v=\d+", n))
    return [v for v in found if fs.exists(_fs(spark, f"{root}/run_id={run_id}/v={v}/{_MANIFEST}")[1])]


def write_run(stages: dict[str, DataFrame], root: str, run_id: str, synthetic: bool) -> int:
    """Write a run's stages as one whole; its number among the run's attempts. A number that is NaN or infinite refuses the run.

    Stage and run names are plain. Nothing of a run is visible before all of it is; a failed write leaves what was there.
    """
    if not re.fullmatch(PLAIN, run_id) or not stages or not all(re.fullmatch(PLAIN, s) for s in stages):
        raise ValueError("stage and run names must be plain")
    spark = next(iter(stages.values())).sparkSession
    pending = f"{root}/_pending/{run_id}-{uuid.uuid4().hex}"
    kinds = {}
    for name, rows in stages.items():
        _guarded(rows).write.option("compression", "zstd").parquet(f"{pending}/stage={name}")
        kinds[name] = json.loads(rows.schema.json())
    fs, at = _fs(spark, f"{pending}/{_MANIFEST}")
    out = fs.create(at)
    out.write(bytearray(json.dumps({"run_id": run_id, "synthetic": synthetic, "stages": kinds}, allow_nan=False).encode()))
    out.close()
    attempt = max(_attempts(spark, root, run_id), default=0) + 1
    _, home = _fs(spark, f"{root}/run_id={run_id}")
    fs.mkdirs(home)
    if not fs.rename(_fs(spark, pending)[1], _fs(spark, f"{root}/run_id={run_id}/v={attempt}")[1]):
        raise OSError(f"{run_id} could not be put in place")
    return attempt


def read_run(spark: SparkSession, root: str, run_id: str, synthetic: bool) -> dict[str, DataFrame]:
    """Stage -> table of the newest whole attempt of a run; ValueError if it is of the other namespace, FileNotFoundError if there is none."""
    found = _attempts(spark, root, run_id)
    if not found:
        raise FileNotFoundError(run_id)
    home = f"{root}/run_id={run_id}/v={found[-1]}"
    text = "\n".join(r.value for r in spark.read.text(f"{home}/{_MANIFEST}").collect())  # the manifest: a few lines
    manifest = json.loads(text)
    if manifest["synthetic"] != synthetic:
        raise ValueError(f"{run_id} is of the other namespace")
    return {name: spark.read.schema(T.StructType.fromJson(kind)).parquet(f"{home}/stage={name}") for name, kind in manifest["stages"].items()}


def part_of(key: str, parts: int):
    """The stored partition of a key."""
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create_table(rows: DataFrame, path: str, key: str, parts: int = 64) -> None:
    """Store rows by the hash of their key: a folder `part=` each."""
    rows.withColumn("part", part_of(key, parts)).repartition("part").write.partitionBy("part").mode("overwrite").parquet(path)


def merge(path: str, changes: DataFrame, key: str, version: str, parts: int = 64) -> None:
    """Put a change set into a stored table: the highest version of each key stays, a row with `gone` deletes its key.

    changes: the table's columns and `gone` boolean. Only partitions that hold a changed key are read and rewritten, by
    one dynamic overwrite; files of the others stay. No change, no write.
    """
    spark = changes.sparkSession
    stored = spark.read.parquet(path)
    columns = [c for c in stored.columns if c != "part"]
    new = changes.select(*columns, "gone").withColumn("part", part_of(key, parts))
    touched = [r.part for r in new.select("part").distinct().collect()]  # at most `parts` numbers
    if not touched:
        return
    old = stored.where(F.col("part").isin(*touched)).select(*columns, F.lit(False).alias("gone"), "part")
    newest = Window.partitionBy("part", key).orderBy(F.desc(version), F.desc("__late"))
    both = old.withColumn("__late", F.lit(0)).unionByName(new.withColumn("__late", F.lit(1)))
    kept = both.withColumn("__k", F.row_number().over(newest)).where("__k = 1 and not gone").drop("__k", "__late", "gone")
    kept = materialize(kept, "merged")  # a job cannot replace the files that it reads
    dynamic = kept.repartition("part").write.option("partitionOverwriteMode", "dynamic").partitionBy("part").mode("overwrite")
    dynamic.parquet(path)
    full = {r.part for r in kept.select("part").distinct().collect()}
    fs, _ = _fs(spark, path)
    for p in set(touched) - full:  # every key of the partition is gone
        fs.delete(_fs(spark, f"{path}/part={p}")[1], True)
