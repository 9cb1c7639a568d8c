"""Derived indexes: token postings, numeric values, and the field names of a store.

They are plain tables made from current records, so they are never stale; write them out where they are read often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import tokens, tokens_of


#: Columns of an index; a subquery on it names columns of records too, which cannot be called so.
TOKEN, RECORD = "__token", "__record"


def postings(df: DataFrame, id_: Column, text: Column) -> DataFrame:
    """(token, _id), one row for each distinct token of a record. A projection without a shuffle.

    The outer explode keeps Spark from inferring a filter on the array, which would cut each text into tokens once more.
    """
    return df.select(id_.alias("_id"), F.explode_outer(F.array_distinct(tokens(text))).alias("token")).where("token IS NOT NULL").select("token", "_id")


def posting_sizes(posted: DataFrame) -> DataFrame:
    """(token, n_records): summed before the shuffle, so a token of every record costs one row a task."""
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("n_records"))


def write_postings(posted: DataFrame, path: str, files: int | None = None) -> None:
    """Postings as Parquet, sorted by token (and id): a search skips all other pages.

    Each task writes the postings of its records as a sorted file of its own, so nothing is shuffled and texts are cut into
    tokens once. With ``files``, postings are ranged into that many, whatever their size, which cuts each text twice.
    """
    keys = posted.columns
    ranged = posted if files is None else posted.repartitionByRange(files, *keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_index(posted: DataFrame, path: str, files: int | None = None) -> None:
    """Postings as :func:`write_postings` stores them, under names that records cannot have: the table that filters look up."""
    write_postings(posted.select(F.col("token").alias(TOKEN), F.col("_id").alias(RECORD)), path, files)


def search_postings(posted: DataFrame, keywords: list[str], mode: str = "and") -> DataFrame:
    """_id of records that meet all (``and``) or some (``or``) keywords; a keyword is met by any of its tokens."""
    wanted = [(number, token) for number, keyword in enumerate(keywords) for token in tokens_of(keyword)]
    numbers = {number for number, _ in wanted}
    if not wanted or (mode == "and" and len(numbers) < len(keywords)):
        return posted.select("_id").limit(0)
    hits = posted.where(F.col("token").isin(sorted({token for _, token in wanted})))
    if mode == "or":
        return hits.select("_id").distinct()
    met = [F.max(F.col("token").isin([t for n, t in wanted if n == number])).alias(f"k{number}") for number in sorted(numbers)]
    every = F.lit(True)
    for number in sorted(numbers):
        every = every & F.col(f"k{number}")
    return hits.groupBy("_id").agg(*met).where(every).select("_id")


def numeric_index(df: DataFrame, id_: Column, value: Column) -> DataFrame:
    """(value, n_records, first_id, last_id) of each number; what is no number is left out."""
    read = df.select(value.try_cast("double").alias("value"), id_.alias("_id")).where("value IS NOT NULL")
    return read.groupBy("value").agg(F.count(F.lit(1)).alias("n_records"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))


def discover_fields(df: DataFrame, doc: str | None = None) -> DataFrame:
    """(field) names over all records: top-level names of a JSON or VARIANT body, or the columns that some record fills."""
    if doc:
        body = F.col(f"`{doc}`")
        body = F.try_parse_json(body) if isinstance(df.schema[doc].dataType, T.StringType) else body
        rows = df.select(body.alias("body")).where("body IS NOT NULL")
        return rows.select(F.explode(F.from_json(F.to_json("body"), "map<string,string>")).alias("field", "_")).select("field").distinct()
    filled = df.agg(*(F.count_if(F.col(f"`{name}`").isNotNull()).alias(name) for name in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("field"), F.col(f"`{name}`").alias("n")) for name in df.columns)))
    return filled.select(pairs.alias("x")).select("x.*").where("n > 0").select("field")


def new_fields(batch: DataFrame, known: DataFrame, doc: str | None = None) -> DataFrame:
    """(field) names in ``batch`` that ``known`` (field) lacks; for use on each micro-batch of a stream."""
    return discover_fields(batch, doc).join(known.select("field").distinct(), "field", "left_anti")


def merged_schema(df: DataFrame, doc: str) -> DataFrame:
    """One row: the schema that all bodies of ``doc`` share, as text."""
    body = F.col(f"`{doc}`")
    body = F.try_parse_json(body) if isinstance(df.schema[doc].dataType, T.StringType) else body
    return df.agg(F.schema_of_variant_agg(body).alias("schema"))
