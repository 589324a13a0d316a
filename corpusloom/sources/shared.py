"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Lets a finished query's shuffle files go at once, not when the driver next collects garbage.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only if the session names none and is local."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all nodes of {master} share")
        where = f"/tmp/checkpoints/{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(where)
    return where


def _files(spark: SparkSession, path: str) -> tuple:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def table(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage: nothing before it is computed again if an executor goes.
    The files go with `drop`, or with the application (deleteOnExit).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    files, place = _files(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables that nothing will read any more."""
    for t in tables:
        path = _paths.pop(t, None)
        if path:
            files, place = _files(t.sparkSession, path)
            files.delete(place, True)
