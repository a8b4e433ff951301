"""What every operator needs of the session: its modules on the workers, and tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN_SCRATCH: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> None:
    """Once an application: the whole package as a zip file, through Spark's own file server, as workers may not see the driver's folders."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="ledgershift-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "ledgershift_modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name in sorted(root.rglob("*.py")):
            z.write(name, name.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, a temporary one in local mode, else the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        shared = spark.conf.get("spark.sql.warehouse.dir")
    if not shared:
        app = spark.sparkContext.applicationId
        if app not in _OWN_SCRATCH:
            _OWN_SCRATCH[app] = f"file://{tempfile.mkdtemp(prefix='ledgershift-')}"
            atexit.register(shutil.rmtree, _OWN_SCRATCH[app].removeprefix("file://"), ignore_errors=True)
        shared = _OWN_SCRATCH[app]
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() can delete what is written there."""
    path = f"{scratch_dir(spark)}/ledgershift/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """The number of tables written so far, for release()."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables written since mark(), except those that `keep` reads."""
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    used = [x.rsplit("/", 1)[0] for x in keep.inputFiles()]
    kept = [p for p in paths[since:] if any(u.endswith(p.rsplit("/", 1)[1]) for u in used)]
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for p in paths[since:]:
        if p not in kept:
            hadoop(p).getFileSystem(conf).delete(hadoop(p), True)
    paths[since:] = kept
