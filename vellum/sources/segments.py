"""Log segments as text: a line for each version, ``id {json}``. Import and export; the engine itself keeps Parquet.

The place of a line comes from the file's name, its numbers read as numbers (a writer's counter may outgrow its zeros, and
``c1000`` follows ``c999``), the offset of its split and the order within the split, so files of any size are read in splits
and no task needs a whole segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.errors import QueryError


def parse_line(line: Column) -> list[Column]:
    """_id and doc of a line; both null for a malformed one."""
    parts = F.split(F.trim(line), " ", 2)
    body = F.try_element_at(parts, F.lit(2))
    good = F.coalesce(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), F.lit(False)) & (parts[0] != "")
    return [F.when(good, parts[0]).alias("_id"), F.when(good, body).alias("doc")]


def name_order(name: Column) -> Column:
    """A text that sorts as ``name`` does with its runs of digits compared as numbers of any length; names that differ in leading zeros alone are equal."""
    runs = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    bare = lambda run: F.ltrim(run, F.lit("0"))
    return F.array_join(F.transform(runs, lambda run: F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(bare(run)).cast("string"), 3, "0"), bare(run))).otherwise(run)), "")


def read_segments(spark: SparkSession, path: str, keep_malformed: bool = False) -> DataFrame:
    """(segment, place, _id, doc, size) of the lines under ``path`` (a folder, file or glob); ``place`` orders lines of all segments."""
    lines = spark.read.text(path)
    meta = lines.select("value", F.col("_metadata.file_name").alias("segment"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = meta.select("segment", F.struct(name_order(F.col("segment")).alias("name"), "segment", "block", "line").alias("place"), *parse_line(F.col("value")), F.octet_length("value").alias("size"), "value")
    return rows if keep_malformed else rows.where("_id IS NOT NULL").drop("value")


def current_versions(lines: DataFrame) -> DataFrame:
    """(_id, doc): the last version of each record."""
    return lines.groupBy("_id").agg(F.max_by("doc", "place").alias("doc"))


def write_segments(docs: DataFrame, path: str, lines_per_file: int = 100_000) -> None:
    """Documents (_id, doc) as segments. An id with white space or a colon, or a body of several lines, has no line format."""
    bad = docs.where(F.coalesce(F.col("_id").rlike(r"[\s:]") | (F.col("_id") == "") | F.col("doc").contains("\n"), F.lit(True)))
    if not bad.isEmpty():
        raise QueryError("some ids or documents cannot be written as lines")
    docs.select(F.concat_ws(" ", "_id", "doc").alias("value")).write.option("maxRecordsPerFile", lines_per_file).text(path)


def read_json_log(spark: SparkSession, path: str, schema: str, n: int | None = None, ts: str = "time") -> DataFrame:
    """A log with a JSON object a line, newest first if only ``n`` rows are wanted."""
    rows = spark.read.schema(schema).json(path)
    return rows if n is None else rows.orderBy(F.desc(ts)).limit(n)
