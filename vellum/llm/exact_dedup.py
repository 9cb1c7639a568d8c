"""Exact dedup: rows meet by a 128-bit content hash, and the bytes decide inside a group.

The plan has two shuffles. The first sends each distinct normalised text once per map task (the hash and the bytes are
the grouping key, and copies are folded before the shuffle, so a text that makes up a third of the corpus costs one row
a task). The second joins the small per-group result back to the rows by hashes alone; it carries no text, and adaptive
execution splits it where a group is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import WHITE, text_or_empty

#: Rank of a row in its group: code points first, then the smaller id. 10^20 exceeds twice any 64-bit id.
_STEP = "100000000000000000000"


def normalised(text: Column) -> Column:
    """``text`` without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, WHITE, "")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Defined cases: a null text is an empty text, and all empty texts are equal. Of a group the row with the most code
    points in the original text stays, then the smallest id. A null id never wins over another id; in a group of null
    ids only, keep_id is null and each row is kept. Rows that repeat an id are counted one by one and share their fate.
    An empty table gives an empty result. Columns other than id and text are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("raw")).select(
        "doc_id", F.length("raw").cast("long").alias("points"), normalised(F.col("raw")).alias("norm")
    )
    hashed = rows.select("doc_id", "points", "norm", F.unhex(F.md5("norm")).alias("hash"))
    rank = F.col("points").cast("decimal(38,0)") * F.lit(_STEP).cast("decimal(21,0)") - F.col("doc_id")
    groups = (
        hashed.groupBy("hash", "norm")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.when(F.col("doc_id").isNotNull(), F.col("points"))).alias("most"),
            F.max(rank.cast("decimal(38,0)")).alias("best"),
        )
        .select(
            "hash",
            F.sha2("norm", 256).alias("text_sha256"),
            "group_size",
            (F.col("most").cast("decimal(38,0)") * F.lit(_STEP).cast("decimal(21,0)") - F.col("best")).cast("long").alias("keep_id"),
        )
    )
    keys = hashed.select("doc_id", "hash", F.sha2("norm", 256).alias("text_sha256"))
    return keys.join(groups, ["hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of equal texts, the one that :func:`find_copies` keeps; columns and their order stay.

    Rows are told apart by their bytes, never by their id, and copies are folded before the one shuffle. Defined cases:
    all null, empty and white texts are equal; the most code points win, then the smallest id, then the least hash of the text; a row
    with a null id stays only in a group without ids; of rows that are equal in all of these one stays; rows that share an id
    and differ in text are not copies; an empty table gives an empty result.
    """
    raw = text_or_empty(text_col)
    norm, doc_id = normalised(raw), F.col(id_col).cast("long")
    row = F.struct(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns)))
    rank = F.struct(doc_id.isNull(), -F.length(raw), doc_id, F.xxhash64(raw))
    keyed = docs.select(norm.alias("norm"), row.alias("row"), rank.alias("rank")).withColumn("hash", F.unhex(F.md5("norm")))
    kept = keyed.groupBy("hash", "norm").agg(F.min_by("row", "rank").alias("row"))
    return kept.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
