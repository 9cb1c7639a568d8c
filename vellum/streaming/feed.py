"""The write path as streams: a coalesced log, a change feed, flushes of a debounced buffer, and rate windows.

Every stream appends its micro-batch under a folder of its own (``batch=N``, overwritten when a batch is retried), so a
restart neither loses nor repeats operations, and readers see whole batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from vellum.operators.fold import wellformed
from vellum.sources.storage import subfolders


def files_as_stream(spark: SparkSession, path: str, schema: T.StructType | str, most_files: int = 256) -> DataFrame:
    """New Parquet files under ``path`` as a stream. A micro-batch takes ``most_files`` at most: files that come faster wait, and no batch outgrows the cluster."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def _write_batches(stream: DataFrame, folder: str, checkpoint: str, shape: Callable[[DataFrame], dict[str, DataFrame]], once: bool) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        for table, rows in shape(batch).items():
            rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    """All finished batches of a table."""
    root = f"{folder}/{table}"
    found = [f"{root}/{name}" for name in subfolders(spark, root)]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def log_operations(ops: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends a stream of operations to the table ``ops`` and its dead letters to ``dead_letters``."""
    columns = ["seq", "_id", "op", "delta"]
    return _write_batches(ops, folder, checkpoint, lambda batch: {"ops": batch.where(wellformed()).select(*columns), "dead_letters": batch.where(~wellformed()).select(*columns)}, once)


def log_latest(rows: DataFrame, keys: list[str], order: list[str], values: list[str], folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to the table ``latest`` one row a key and batch: the last values of the key. Folding these folds the stream."""

    def last(batch: DataFrame) -> dict[str, DataFrame]:
        top = batch.groupBy(*keys).agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("row"))
        return {"latest": top.select(*keys, "row.*")}

    return _write_batches(rows, folder, checkpoint, last, once)


def change_feed(ops: DataFrame, store: str) -> DataFrame:
    """What subscribers of a store get to see of its operations: type, store, record_id, op. For streams and tables alike."""
    rows = ops.where(F.col("store") == store) if "store" in ops.columns else ops
    return rows.select(F.lit("update").alias("type"), F.lit(store).alias("store"), F.col("_id").alias("record_id"), "op")


def subscribe(ops: DataFrame, store: str, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls ``callback(changes, batch number)`` for each micro-batch of changes to ``store``."""
    writer = change_feed(ops, store).writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def debounced_stream(ops: DataFrame, quiet: str = "5 seconds", late: str = "0 seconds") -> DataFrame:
    """Flushes of a debounced buffer as a stream: (_id, began, ended, n_writes). A flush leaves once the watermark passes it."""
    timed = ops.select("_id", "seq", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = timed.groupBy("_id", F.session_window("ts", quiet)).agg(F.count(F.lit(1)).alias("n_writes"), F.min("ts").alias("began"), F.max("ts").alias("ended"))
    return rows.select("_id", "began", "ended", "n_writes")


def rate_stream(requests: DataFrame, keys: list[str], ts: str, seconds: float, limit: int, late: str = "1 second") -> DataFrame:
    """Keys with more than ``limit`` requests in a tumbling window of ``seconds``: the streaming alarm (the exact trailing count is a batch query)."""
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = timed.groupBy(*keys, F.window(ts, f"{seconds} seconds").alias("during")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > limit).select(*keys, F.col("during.start").alias("began"), "n")
