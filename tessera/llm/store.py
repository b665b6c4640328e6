"""Where intermediate tables go: the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The session's shared folder; only where none is set (a local session), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again, which cuts its lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop(*dfs: DataFrame) -> None:
    """Delete tables that saved() wrote and nothing reads any more."""
    for df in dfs:
        remove(df.sparkSession, df.saved_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. One of some MB in fewer files than there are cores, and too small to give each a part, is dealt
    to all of them; larger tables are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 1 << 20 < size < cores << 26 and len(df.inputFiles()) < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of the session, once, so that Python workers there can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera"), "zip", root, "tessera")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def free(spark: SparkSession) -> None:
    """Let the driver find shuffles that nothing refers to, so that their files go before the next stages write more."""
    for _ in range(2):  # what the first pass lets go of, listeners among it, frees more in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
