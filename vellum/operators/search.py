"""Queries on one store: filter, total, order, page, records."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.errors import QueryError, QueryTimeout
from vellum.model import StoreSpec
from vellum.plans.builder import Q
from vellum.plans.filters import FilterCompiler, record_id

#: Words of a request that are no fields where a filter stands alone.
RESERVED = ("sort", "limit", "offset", "hydrate", "store")


@dataclass(frozen=True)
class Request:
    """A query taken apart."""

    filter: Any
    sort: str | None = None
    limit: int | None = None
    offset: int = 0


def read_request(query: Q | dict) -> Request:
    """Of a builder, of ``{"filter": ..., "sort": ..., "limit": ..., "offset": ...}``, or of a filter with those words beside its fields."""
    query = query.build() if isinstance(query, Q) else query
    if not isinstance(query, dict):
        raise QueryError("a query is a dict or a Q")
    filter_ = query["filter"] if "filter" in query else {k: v for k, v in query.items() if k not in RESERVED}
    sort, limit, offset = (query.get(k) for k in ("sort", "limit", "offset"))
    try:
        return Request(filter_, sort or None, None if limit is None else int(limit), 0 if offset is None else int(offset))
    except (TypeError, ValueError):
        raise QueryError("limit and offset are whole numbers") from None


def matching(df: DataFrame, spec: StoreSpec, query: Q | dict, extra: Column | None = None) -> DataFrame:
    """All records that match, with all columns. ``extra`` is a further predicate of any kind."""
    found = df.where(FilterCompiler(spec, df).column(read_request(query).filter))
    return found if extra is None else found.where(extra)


def order_of(df: DataFrame, spec: StoreSpec, sort: str | None) -> list[Column]:
    """Sort columns: the asked field (nulls first if ascending, last if descending), then the id, so that pages are stable."""
    tie = [F.col(f"`{name}`") for name in (("_id",) if "_id" in df.columns else spec.key or [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)])]
    if not sort:
        return tie
    name = sort.lstrip("+-")
    if spec.doc:
        body = F.col(f"`{spec.doc}`")
        body = F.try_parse_json(body) if isinstance(df.schema[spec.doc].dataType, T.StringType) else body
        path = "$" + "".join(f"['{part}']" for part in (name.split(".") if spec.nested else [name]))
        keys = [F.try_variant_get(body, path, "double"), F.try_variant_get(body, path, "string")]
    elif name == "_id":
        keys = [record_id(spec, df)]
    elif spec.nested and "." in name:
        keys = [F.col(".".join(f"`{part}`" for part in name.split(".")))]
    else:
        keys = [F.col(f"`{name}`")] if name in df.columns else []
    return [key.desc_nulls_last() if sort[0] == "-" else key.asc_nulls_first() for key in keys] + tie


def page(df: DataFrame, spec: StoreSpec, query: Q | dict, extra: Column | None = None) -> DataFrame:
    """The asked page of matching records, in order, with all columns. It becomes one top-k, not a sort of all matches."""
    request = read_request(query)
    limit = request.limit if request.limit is not None else spec.default_limit if spec.default_limit > 0 else None
    out = matching(df, spec, query, extra).orderBy(*order_of(df, spec, request.sort))
    if request.offset > 0:
        out = out.offset(request.offset)
    return out if limit is None else out.limit(max(limit, 0))


def with_id(df: DataFrame, spec: StoreSpec) -> DataFrame:
    return df if "_id" in df.columns else df.select(record_id(spec, df).alias("_id"), "*")


def total_matches(df: DataFrame, spec: StoreSpec, query: Q | dict) -> int:
    return matching(df, spec, query).count()


def point_read(df: DataFrame, spec: StoreSpec, id_: str) -> Row | None:
    found = with_id(matching(df, spec, {"filter": {"_id": str(id_)}}), spec).limit(1).collect()
    return found[0] if found else None


def multi_read(df: DataFrame, spec: StoreSpec, ids: list[str]) -> DataFrame:
    """Records of the ids that exist; a long list goes in as a table and Spark picks the join by its size."""
    if len(ids) <= 1000:
        return with_id(matching(df, spec, {"filter": {"_id": {"in": [str(x) for x in ids]}}}), spec)
    wanted = df.sparkSession.createDataFrame([(str(x),) for x in ids], "_id string")
    return with_id(df, spec).join(wanted, "_id", "left_semi")


def exists(df: DataFrame, spec: StoreSpec, id_: str) -> bool:
    return not matching(df, spec, {"filter": {"_id": str(id_)}}).isEmpty()


def hydrate(df: DataFrame, spec: StoreSpec, ids: DataFrame) -> DataFrame:
    """Records whose ``_id`` is in ``ids``; ids without a record are dropped."""
    return with_id(df, spec).join(ids.select("_id"), "_id", "left_semi")


@dataclass
class QueryResult:
    """A page on the driver, at most as long as its limit."""

    store: str
    ids: list[str]
    total_matches: int
    duration_ms: float
    records: list[dict] | None = None

    @property
    def count(self) -> int:
        return len(self.ids)

    def __len__(self) -> int:
        return len(self.ids)

    def __bool__(self) -> bool:
        return bool(self.ids)

    def __iter__(self):
        return iter(self.ids if self.records is None else self.records)

    def payload(self) -> dict:
        """As a response has it: ids or records, never both."""
        rows = {"ids": self.ids} if self.records is None else {"records": self.records}
        return {"count": self.count, "total_matches": self.total_matches, **rows, "duration_ms": round(self.duration_ms, 2)}


def run_query(df: DataFrame, spec: StoreSpec, query: Q | dict, hydrate: bool = False, extra: Column | None = None) -> QueryResult:
    """Runs a query within the time limit of its store."""
    began = time.monotonic()

    def work() -> tuple[list[Row], int]:
        rows = with_id(page(df, spec, query, extra), spec)
        got = (rows if hydrate else rows.select("_id")).collect()
        request = read_request(query)
        whole = request.limit is None and request.offset == 0 and (spec.default_limit <= 0 or len(got) < spec.default_limit)
        return got, len(got) if whole else matching(df, spec, query, extra).count()

    rows, total = within(df, spec.timeout_ms, work)
    records = [row.asDict(recursive=True) for row in rows] if hydrate else None
    return QueryResult(spec.name, [row["_id"] for row in rows], total, (time.monotonic() - began) * 1000, records)


def within(df: DataFrame, timeout_ms: float, work: Callable) -> Any:
    """The value of ``work()``; its Spark jobs are cancelled after ``timeout_ms`` (0: never)."""
    if timeout_ms <= 0:
        return work()
    context, group, late = df.sparkSession.sparkContext, f"vellum-{uuid.uuid4().hex}", threading.Event()
    names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = [context.getLocalProperty(name) for name in names]

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(timeout_ms / 1000, stop)
    context.setJobGroup(group, "a query with a time limit", interruptOnCancel=True)
    timer.start()
    try:
        value = work()
    except Exception as error:
        if late.is_set():
            raise QueryTimeout(f"the query took more than {timeout_ms:g} ms") from error
        raise
    finally:
        timer.cancel()
        for name, old in zip(names, before, strict=True):
            context.setLocalProperty(name, old)
    if late.is_set():
        raise QueryTimeout(f"the query took more than {timeout_ms:g} ms")
    return value
