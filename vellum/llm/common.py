"""Helpers shared by the text operators: lineage cuts and column names that cannot clash."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of ``[\x20\x09-\x0D]``, the only white space that the operators know.
WHITE = " \t\n\x0b\x0c\r"
_tables: ContextVar[str | None] = ContextVar("tables", default=None)
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on one machine, as in a test, a temporary folder stands in for it; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="vellum-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def tables_for(spark: SparkSession, what: str) -> Iterator[str]:
    """A folder of its own for what :func:`written` writes meanwhile. It is deleted at the end, so results must be stored elsewhere by then."""
    folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    token = _tables.set(folder)
    try:
        yield folder
    finally:
        _tables.reset(token)
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs a reread and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: compressed, and columns can still be pruned."""
    path = f"{_tables.get() or shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    """The text column, null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def long_id(docs: DataFrame, name: str = "doc_id") -> Column:
    """The id column as a long. One that is a long already stays unnamed anew: a new name would keep Spark from reusing shuffles of it."""
    return F.col(name) if docs.schema[name].dataType == T.LongType() else F.col(name).cast("long").alias(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of this session hold 4 MB, where the session has Spark's own 64 MB: a worker and its executor hold several, some twice."""
    if spark.conf.get(_BATCH_BYTES) == "67108864b":
        spark.conf.set(_BATCH_BYTES, str(4 * 2**20))


def bit_map(df: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """2^bits bits as 64-bit words, those of the values of ``slot`` set: at most 2^(bits - 6) words reach the driver, whatever the input."""
    rows = df.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(2 ** (bits - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def bits_of(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of ``slots`` are set in a bit map."""
    return (words[slots >> 6] >> (slots & 63)) & 1 == 1


def texts_of(column: pa.Array, size: int = 256) -> Iterator[str]:
    """The values of an Arrow column one by one, of which only some are Python texts at a time."""
    for at in range(0, len(column), size):
        yield from column.slice(at, size).to_pylist()


def slices_of(batches: Iterable[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of at most ``size`` rows, none of them empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def batches_of(values: Iterable, size: int) -> Iterable[list]:
    """``values`` in lists of at most ``size``."""
    held: list = []
    for value in values:
        held.append(value)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
