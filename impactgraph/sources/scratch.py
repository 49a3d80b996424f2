"""Folders for tables that an operator writes and reads again: below spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of its own where that is unset, which only a local master may have."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="impactgraph-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes with the driver, or by `remove` before."""
    root = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    path, fs = _at(spark, root)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return root


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in a folder of its own; later plans read the columns that they need. Column names differ, and
    their types are such that Parquet has."""
    path = f"{folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
