"""A corpus pipeline of five text operators: quality, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes it as Parquet and rereads it as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellum.llm import common, exact_dedup, minhash, packing, quality, secret_scan


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score under 0.5)."""
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies."""
    return minhash.drop_near_duplicates(docs, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets inside texts."""
    return secret_scan.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all remaining documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Model training, signatures and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared checkpoint folder and reread; of these only the last stays."""
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with common.tables_for(spark, name):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            common.delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
