"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def root(spark: SparkSession) -> str:
    """The shared folder. A temporary one only where none is named and driver and executors are one
    process; ValueError on a cluster, where executors don't see each other's folders."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            named = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="recallery-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver's Python ends."""
    path = f"{root(spark)}/recallery/{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        atexit.register(_delete, where.getFileSystem(spark._jsc.hadoopConfiguration()), where)
    return path


def _delete(files, where) -> None:
    try:
        files.delete(where, True)
    except (OSError, Py4JError):  # the JVM is gone
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back. Its plan becomes a scan, so what
    reads it several times is planned and computed once, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A table dealt to all cores if it comes in fewer partitions than there are, as a small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
