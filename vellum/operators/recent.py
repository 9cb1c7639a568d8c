"""Latest rows, expiry, and sliding rate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sizes of the event log and of the logs of one store.
EVENTS, PER_STORE = 200, 50


def latest_events(log: DataFrame, n: int = EVENTS, level: str | None = None, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The newest rows of a log, newest first; a level filters before the limit, and the limit lies between 1 and 200."""
    rows = log if not level else log.where(F.col("level") == level)
    return rows.orderBy(*(F.desc(c) for c in order)).limit(max(1, min(n, EVENTS)))


def latest_per_key(log: DataFrame, keys: list[str], order: list[str], n: int = PER_STORE) -> DataFrame:
    """The newest ``n`` rows of each key with their rank. Each task drops what cannot be among them before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return log.withColumn("rank", rank).where(F.col("rank") <= n)


def slow_queries(log: DataFrame, threshold_ms: float, keys: list[str], order: list[str], n: int = PER_STORE) -> DataFrame:
    """The newest slow rows of each key; a threshold of 0 turns the log off."""
    slow = log.where(F.lit(threshold_ms > 0) & (F.col("duration_ms") >= threshold_ms))
    return latest_per_key(slow, keys, order, n)


def unexpired(rows: DataFrame, ts: str, now: Column, ttl_seconds: float) -> DataFrame:
    """Rows at most ``ttl_seconds`` old (0 or less: all)."""
    if ttl_seconds <= 0:
        return rows
    return rows.where(F.col(ts) >= now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)).cast("decimal(18,6)")))


def evicted(accesses: DataFrame, id_: str, ts: str, max_size: int, by: str = "lru") -> DataFrame:
    """Ids that do not fit a cache of ``max_size``: the least recently (``lru``) or least often (``lfu``) used ones.

    The survivors are a top-k of known size, so no task sorts all ids.
    """
    used = accesses.groupBy(F.col(id_).alias("_id")).agg(F.max(ts).alias("last_access"), F.count(F.lit(1)).alias("frequency"))
    first = [F.desc("last_access")] if by == "lru" else [F.desc("frequency"), F.desc("last_access")]
    kept = used.orderBy(*first, F.desc("_id")).limit(max_size).select("_id")
    return used.join(kept, "_id", "left_anti")


def rate_window(requests: DataFrame, keys: list[str], ts: str, seconds: float, inclusive: bool = False) -> DataFrame:
    """``requests`` with ``in_window``: how many of the key fall into the ``seconds`` up to each row, itself included.

    A request exactly ``seconds`` earlier counts only if ``inclusive``. The time of a key is cut into slots of 64 windows;
    a request near the end of a slot also enters the next slot as context. So each key is spread over tasks by time, and
    at most some of the rows are sent twice.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    reach = round(seconds * 1e6) - (0 if inclusive else 1)
    width = max(1, 64 * reach)
    slot = F.floor(micros / F.lit(width)).cast("long")
    both = F.when(F.floor((micros + reach) / F.lit(width)).cast("long") > slot, F.array(slot, slot + 1)).otherwise(F.array(slot))
    placed = requests.withColumn("__at", micros).withColumn("__own", slot).withColumn("__slot", F.explode(both))
    count = F.count(F.lit(1)).over(W.partitionBy(*keys, "__slot").orderBy("__at").rangeBetween(-reach, 0))
    return placed.withColumn("in_window", count).where("__own = __slot").drop("__at", "__own", "__slot")


def blocked(requests: DataFrame, keys: list[str], ts: str, limit: int, seconds: float = 1.0) -> DataFrame:
    """Requests beyond ``limit`` within the trailing window of their key."""
    return rate_window(requests, keys, ts, seconds).where(F.col("in_window") > limit)
