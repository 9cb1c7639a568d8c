"""A manifest of files, and what has become of them: finds damage; repair is up to the file system's replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files under ``path`` whose names fit ``pattern``; each task reads whole files, so keep them under 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def damaged(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, state) of files that are ``missing`` or ``changed`` since the manifest ``before``."""
    joined = before.select("path", F.col("sha256").alias("was")).join(now.select("path", F.col("sha256").alias("is")), "path", "left")
    return joined.where("is IS NULL OR is <> was").select("path", F.when(F.col("is").isNull(), "missing").otherwise("changed").alias("state"))
