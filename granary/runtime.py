"""What every plan needs from the session: shared storage, shipping the package, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side may be broadcast; callers count before they hint.
BROADCAST_ROWS = 1_000_000

_shipped: set[str] = set()
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a folder of this machine serves a session that runs on this machine alone; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark.sparkContext, "_granary_shared", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="granary-")
        spark.sparkContext._granary_shared = made
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as parquet into the shared folder and read it back: survives lost executors, compresses, prunes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary-{name}-{uuid.uuid4().hex}"
    if not _stored:
        atexit.register(discard, spark)
    _stored.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more, before the session ends."""
    for df in tables:
        path = getattr(df, "_granary_path", None)
        if path in _stored:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            _stored.remove(path)


def discard(spark: SparkSession) -> None:
    """Remove what stored() wrote. Done at the end of the application; results that are still read need it until then."""
    try:
        for path in _stored:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone; the shared folder is the cluster's to clear then
        pass
    _stored.clear()


def fingerprint(spark: SparkSession, path: str) -> str:
    """A path with the sizes and times of its files: equal as long as nothing there was written."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    files = fs.listStatus(p) if status.isDirectory() else [status]
    return path + "|" + ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster, once per application."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="granary-zip-")  # on the driver only; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "granary.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("granary") / p.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df


#: Tables with long texts, whose rows take time.
TEXTS = ("documents", "scheme_chunks", "aif_activities")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df
