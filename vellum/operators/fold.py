"""Current state from a log of partial writes and deletes.

A log (``ops``) has seq long, _id string, op string (``write`` or ``delete``) and delta string (a JSON object); other
columns are ignored. Operations of a record count in the order of ``seq``; a delete forgets all before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.patches import History, patch_of, read_delta
from vellum.functions.patches import flat as flat_document

OPS = "seq long, _id string, op string, delta string"


def since_last_delete(ops: DataFrame) -> DataFrame:
    """The writes that no later delete of their record undoes."""
    deletes = ops.where("op = 'delete'").groupBy("_id").agg(F.max("seq").alias("deleted"))
    return ops.where("op = 'write' AND _id IS NOT NULL").join(deletes, "_id", "left").where("deleted IS NULL OR seq > deleted").drop("deleted")


def wellformed() -> Column:
    """True for operations with an id that delete, or write a JSON object; all others are dead letters."""
    body = F.schema_of_variant(F.try_parse_json("delta"))
    return F.coalesce(F.col("_id").isNotNull() & ((F.col("op") == "delete") | ((F.col("op") == "write") & body.startswith("OBJECT"))), F.lit(False))


def latest(rows: DataFrame, key: str | list[str], order: list[str], *values: str) -> DataFrame:
    """The values of the last row of each key, by ``order``. Sums up before the shuffle; a null value of the last row stays null."""
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last")).select(*keys, "last.*")


def latest_fields(ops: DataFrame) -> DataFrame:
    """(_id, field, value): the last value of each top-level field, as JSON text. A record without fields has one row with nulls."""
    live = since_last_delete(ops).select("_id", "seq", F.try_parse_json("delta").alias("body")).where(F.schema_of_variant("body").startswith("OBJECT"))
    exploded = live.lateralJoin(live.sparkSession.tvf.variant_explode_outer(F.col("body").outer()))
    fields = exploded.select("_id", "seq", F.col("key").alias("field"), F.when(F.col("key").isNotNull(), F.coalesce(F.to_json("value"), F.lit("null"))).alias("value"))
    return fields.groupBy("_id", "field").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))


def fold_shallow(ops: DataFrame) -> DataFrame:
    """(_id, doc): every live record as JSON, fields by name. Later values of a field replace earlier ones whole; null is a value.

    Writes of a field are summed up to the last one before the shuffle, so a record with any number of writes costs one
    row for each of its fields and tasks. Malformed operations do nothing, see :func:`wellformed`.
    """
    spelled = F.transform(F.sort_array(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value")))), lambda x: F.concat(_quoted(x["field"]), F.lit(":"), x["value"]))
    return latest_fields(ops).groupBy("_id").agg(F.concat(F.lit("{"), F.array_join(spelled, ","), F.lit("}")).alias("doc"))


def _quoted(name: Column) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.array(name))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


_STEPS = "_id string, seq long, history string"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histories of runs of rows with one id; rows come sorted by id and seq."""
    for ids, seqs, histories in _runs(batches, _read_op):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(seqs, pa.int64()), pa.array([h.dumps() for h in histories], pa.string())], names=["_id", "seq", "history"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as histories of whole records."""
    import json

    for ids, _, histories in _runs(batches, lambda row: History.loads(row["history"])):
        docs = [h.document() for h in histories]
        texts = [None if d is None else json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for d in docs]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["_id", "doc"])


def _read_op(row: dict) -> History:
    history = History()
    if row["op"] == "delete":
        history.delete()
    elif row["op"] == "write" and (delta := read_delta(row["delta"])) is not None:
        history.write(patch_of(delta))
    return history


def _runs(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[list, list, list]]:
    ids, seqs, histories = [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if ids and ids[-1] == row["_id"]:
                histories[-1].then(read(row))
                continue
            if len(ids) >= 4096:
                yield ids, seqs, histories
                ids, seqs, histories = [], [], []
            ids.append(row["_id"])
            seqs.append(row["seq"])
            histories.append(read(row))
    if ids:
        yield ids, seqs, histories


def fold_deep(ops: DataFrame) -> DataFrame:
    """(_id, doc): every live record as JSON, keys sorted; objects merge into objects, null removes, dotted keys are paths.

    The log is ranged by id and seq, so that a busy record spreads over tasks; each task composes the operations it has of
    a record into one patch, and a second step composes these, one a task at most.
    """
    known = ops.where("_id IS NOT NULL").select("seq", "_id", "op", "delta")
    parts = known.repartitionByRange("_id", "seq").sortWithinPartitions("_id", "seq", "op", "delta").mapInArrow(_compose, _STEPS)
    return parts.repartition("_id").sortWithinPartitions("_id", "seq").mapInArrow(_finish, "_id string, doc string").where("doc IS NOT NULL")


def fold(ops: DataFrame, nested: bool) -> DataFrame:
    return fold_deep(ops) if nested else fold_shallow(ops)


def compacted(ops: DataFrame, nested: bool = False) -> DataFrame:
    """The log with one write for each live record, at the seq of its last operation. It folds to what ``ops`` folds to."""
    last = ops.groupBy("_id").agg(F.max("seq").alias("seq"))
    return fold(ops, nested).join(last, "_id").select("seq", "_id", F.lit("write").alias("op"), F.col("doc").alias("delta"))


def dead_ratio(entries: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Of (segment, _id, seq, size) rows: bytes of each segment, bytes of current versions in it, and whether it is worth rewriting.

    A segment without current versions has nothing to rewrite and is left alone.
    """
    last = entries.groupBy("_id").agg(F.max("seq").alias("seq"), F.lit(True).alias("live"))
    sized = entries.join(last, ["_id", "seq"], "left").groupBy("segment").agg(F.sum("size").alias("physical"), F.sum(F.when(F.col("live"), F.col("size")).otherwise(0)).alias("logical"))
    ratio = F.when(F.col("physical") > 0, (F.col("physical") - F.col("logical")) / F.col("physical")).otherwise(0.0)
    return sized.select("segment", "physical", "logical", F.round(ratio, 6).alias("dead"), ((ratio > threshold) & (F.col("logical") > 0)).alias("compact"))


def segment_members(entries: DataFrame, segment: int) -> DataFrame:
    """_id of the records whose current version lies in ``segment``."""
    return latest(entries, "_id", ["seq"], "segment").where(F.col("segment") == segment).select("_id")


def debounced(ops: DataFrame, quiet: float = 5.0) -> DataFrame:
    """Flushes of a write buffer that waits until a record was quiet for ``quiet`` seconds: (_id, began, ended, n_writes, first_seq, last_seq).

    Two operations exactly ``quiet`` apart fall into one flush. ``ts`` may be of either timestamp type. The time of a
    record is cut into slots of 64 quiet times, and flushes are formed within slots, so a busy record is spread over
    tasks; only the first and last flush of each slot are then joined to those of the slots beside it.
    """
    reach = max(1, round(quiet * 1e6))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = ops.select("_id", F.floor(at / F.lit(64 * reach)).alias("slot"), at.alias("began_at"), at.alias("ended_at"), F.lit(1).cast("long").alias("n_writes"), F.col("ts").alias("began"), F.col("ts").alias("ended"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"))
    parts = _joined(rows, ["_id", "slot"], reach).withColumn("last", F.max("flush").over(W.partitionBy("_id", "slot")))
    border = (F.col("flush") == 1) | (F.col("flush") == F.col("last"))
    columns = ["_id", "began", "ended", "n_writes", "first_seq", "last_seq"]
    return parts.where(~border).select(*columns).unionByName(_joined(parts.where(border), ["_id"], reach).select(*columns))


def _joined(flushes: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Flushes of each key that lie at most ``reach`` microseconds apart as one, numbered from 1."""
    order = W.partitionBy(*keys).orderBy("began_at", "first_seq")
    fresh = F.when(F.col("began_at") - F.lag("ended_at").over(order) <= reach, 0).otherwise(1)
    numbered = flushes.withColumn("fresh", fresh).withColumn("flush", F.sum("fresh").over(order))
    least, most = ([f(c).alias(c) for c in columns] for f, columns in ((F.min, ("began_at", "began", "first_seq")), (F.max, ("ended_at", "ended", "last_seq"))))
    return numbered.groupBy(*keys, "flush").agg(F.sum("n_writes").alias("n_writes"), *least, *most)


def flat_paths(docs: DataFrame) -> DataFrame:
    """(_id, path, value): the leaves of JSON documents (_id, doc), as JSON text."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            ids, paths, values = [], [], []
            for id_, text in zip(batch.column("_id").to_pylist(), batch.column("doc").to_pylist(), strict=True):
                doc = read_delta(text, nested=False) or {}
                for path, value in flat_document(doc).items():
                    ids.append(id_)
                    paths.append(path)
                    values.append(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["_id", "path", "value"])

    return docs.select("_id", "doc").mapInArrow(leaves, "_id string, path string, value string")


def diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """What changed between two snapshots with one row a key: keys, old, new and change (``added``, ``changed``, ``removed``)."""
    there = F.lit(True).alias("there")
    old, new = (x.select(*keys, F.col(value).alias(name), there.alias(f"in_{name}")) for x, name in ((before, "old"), (after, "new")))
    both = old.join(new, keys, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")) | F.col("in_old").isNull() | F.col("in_new").isNull())
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    return both.select(*keys, "old", "new", change.alias("change"))


def flatten_columns(schema: T.StructType) -> list[Column]:
    """The leaves of a typed row as columns with dotted names."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for field in kind.fields:
            here = (*path, field.name)
            out += leaves(field.dataType, here) if isinstance(field.dataType, T.StructType) else [F.col(".".join(f"`{part}`" for part in here)).alias(".".join(here))]
        return out

    return leaves(schema, ())


def nest_columns(names: list[str]) -> list[Column]:
    """Columns with dotted names as nested structs: the inverse of :func:`flatten_columns`."""

    def build(paths: list[tuple[tuple[str, ...], str]]) -> list[Column]:
        groups: dict[str, list] = {}
        for path, name in paths:
            groups.setdefault(path[0], []).append((path[1:], name))
        return [F.col(f"`{inner[0][1]}`").alias(top) if not inner[0][0] else F.struct(*build(inner)).alias(top) for top, inner in groups.items()]

    return build([(tuple(name.split(".")), name) for name in names])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
