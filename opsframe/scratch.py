"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in a single JVM may leave it unset; it then gets a folder of
    its own.  On a cluster a local folder would be unreadable elsewhere, so an
    unset folder is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="opsframe-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def hadoop_path(spark: SparkSession, path: str):
    """The folder as a path of its file system, and that file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder; what is there goes when the driver's JVM ends, if it was not deleted before."""
    path = f"{shared_dir(spark).rstrip('/')}/opsframe-{name}-{uuid.uuid4().hex}"
    folder, files = hadoop_path(spark, path)
    files.deleteOnExit(folder)
    return path


def delete(spark: SparkSession, path: str) -> None:
    folder, files = hadoop_path(spark, path)
    files.delete(folder, True)


def write_to(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later jobs read the files, so a lost executor costs at most the tasks that
    were running there.  The files live as long as the driver's JVM does.
    """
    return write_to(df, scratch_path(df.sparkSession, name))
