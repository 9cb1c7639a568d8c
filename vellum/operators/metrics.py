"""Operational figures from a request log.

A log has ts, store, op (read, write, delete, query, error, rate_limited), client, transport (http or socket), bytes_in,
bytes_out, duration_ms and message. All groupings sum up before the shuffle, so a busy store or client costs a row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.model import StoreSpec

#: Counters by the operation they count.
COUNTERS = {"read": "reads", "write": "writes", "delete": "deletes", "query": "queries", "error": "errors", "rate_limited": "rate_limited"}


def counters() -> list[Column]:
    counts = [F.count_if(F.lower("op") == op).alias(name) for op, name in COUNTERS.items()]
    return counts + [F.coalesce(F.sum(size), F.lit(0)).alias(size) for size in ("bytes_in", "bytes_out")]


def transport() -> Column:
    """Anything but ``socket`` counts as ``http``."""
    return F.when(F.col("transport") == "socket", "socket").otherwise("http")


def _named(log: DataFrame) -> DataFrame:
    return log.where("coalesce(store, '') <> ''")


def by_store(log: DataFrame) -> DataFrame:
    return _named(log).groupBy("store").agg(*counters())


def by_transport(log: DataFrame) -> DataFrame:
    return _named(log).withColumn("transport", transport()).groupBy("store", "transport").agg(*counters())


def by_client(log: DataFrame) -> DataFrame:
    return _named(log).where("coalesce(client, '') <> ''").groupBy("store", "client").agg(*counters())


def breakdown(log: DataFrame) -> DataFrame:
    """Stores, their transports and their clients in one pass over the log; ``level`` names the grouping."""
    rows = _named(log).withColumn("transport", transport())
    sets = rows.groupingSets([["store"], ["store", "transport"], ["store", "client"]], "store", "transport", "client")
    level = F.when(F.grouping("transport") == 0, "transport").when(F.grouping("client") == 0, "client").otherwise("store")
    return sets.agg(level.alias("level"), *counters()).where("level <> 'client' OR coalesce(client, '') <> ''")


def totals(log: DataFrame) -> DataFrame:
    """Every store, and all together (store null)."""
    return _named(log).rollup("store").agg(*counters())


def top_clients(log: DataFrame, n: int = 10) -> DataFrame:
    """The clients with most reads, writes and queries."""
    busy = F.col("reads") + F.col("writes") + F.col("queries")
    return by_client(log).withColumn("activity", busy).orderBy(F.desc("activity"), "store", "client").limit(n)


def limited_clients(log: DataFrame) -> DataFrame:
    """How often each address was turned away, most first."""
    return _named(log).where("op = 'rate_limited'").groupBy("store", F.col("client").alias("ip")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "store", "ip")


def all_stores(stores: DataFrame, log: DataFrame) -> DataFrame:
    """A row for each store of ``stores`` (name), zeros where the log knows nothing of it."""
    counted = by_store(log)
    joined = stores.select(F.col("name").alias("store")).join(counted, "store", "left")
    return joined.select("store", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counted.columns if c != "store"))


def health(specs: list[StoreSpec]) -> str:
    """The worst state of ids among stores."""
    states = {spec.identity.health for spec in specs}
    return next((state for state in ("degraded", "low") if state in states), "ok")


def record_counts(stores: dict[str, DataFrame]) -> DataFrame:
    """(name, record_count) of each store."""
    from vellum.operators.fold import union_all

    return union_all([df.agg(F.count(F.lit(1)).alias("record_count")).select(F.lit(name).alias("name"), "record_count") for name, df in sorted(stores.items())])
