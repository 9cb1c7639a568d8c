"""Where the engine reads and writes tables: Parquet folders in a store that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def subfolders(spark: SparkSession, path: str, holding: str = "_SUCCESS") -> list[str]:
    """Names of the folders in ``path`` that hold an entry of that name, sorted; by default those of finished Spark writes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [status.getPath() for status in files.listStatus(where) if status.isDirectory()]
    return sorted(p.getName() for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, holding)))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, to))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"{path} could not be moved to {to}")
