"""Tables written to the folder that all executors share, where a loop or a plan reads the same rows several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, and on a local master alone, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """A folder, there or to come, that goes when the driver's JVM ends."""
    fs, at = _at(spark, path)
    fs.deleteOnExit(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from then on. The files go with drop(), or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    gone_at_exit(spark, path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_at = path
    return found


def drop(*frames: DataFrame | None) -> None:
    """Removes written tables that nothing reads any more."""
    for df in frames:
        if df is not None and getattr(df, "_written_at", None):
            remove(df.sparkSession, df._written_at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, sorted; nothing if there is none."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of a table's files: another stamp, other rows."""
    fs, at = _at(spark, path)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(at)))
