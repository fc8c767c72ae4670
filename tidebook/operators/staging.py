"""Cutting lineage: tables of the running application in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidebook-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a table of this application, in a folder that goes when the application ends."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/tables-{spark.sparkContext.applicationId}"
    fs, p = _file_system(spark, base)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared checkpoint folder and return it read back, free of its lineage.

    Later plans read only the columns that they need. The shuffle files of df's own plan go as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A plan takes the setting when it is made.
        df.select("*").write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that no later plan reads."""
    for t in tables:
        if path := _paths.pop(t, None):
            fs, p = _file_system(t.sparkSession, path)
            fs.delete(p, True)
