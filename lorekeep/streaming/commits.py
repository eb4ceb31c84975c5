"""Markers in a shared folder that say which batches are whole, through Hadoop's file system so that any store will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put(spark: SparkSession, base: str, batch: int) -> bool:
    """Puts the marker of a batch if it is absent; whether it was."""
    fs, p = _at(spark, f"{base}/commits/{batch}")
    return fs.createNewFile(p)


def committed(spark: SparkSession, base: str, batch: int) -> bool:
    fs, p = _at(spark, f"{base}/commits/{batch}")
    return fs.exists(p)


def all_of(spark: SparkSession, base: str) -> list[int]:
    """The whole batches, in order."""
    fs, p = _at(spark, f"{base}/commits")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []
