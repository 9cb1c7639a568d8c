"""Latest rows, rate windows, expiry, eviction and figures of a small request log."""

import datetime
import random

from pyspark.sql import functions as F

from vellum.model import Identity, StoreSpec
from vellum.operators import metrics, recent

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(microseconds=round(seconds * 1e6))


def test_rate_window_matches_brute_force(spark):
    r = random.Random(2)
    times = [0.0, 1.0, 2.0, 2.000001] + [r.uniform(0, 300) for _ in range(300)] + [63.9999, 64.0, 64.5, 127.99, 128.2]
    rows = [(n, "hot" if n % 3 else "cold", at(t)) for n, t in enumerate(times)] + [(900, "hot", at(1.0)), (901, None, at(5))]
    df = spark.createDataFrame(rows, "n int, ip string, ts timestamp_ntz")
    for inclusive in (False, True):
        got = {x.n: x.in_window for x in recent.rate_window(df, ["ip"], "ts", 1.0, inclusive).collect()}
        reach = datetime.timedelta(seconds=1)
        want = {n: sum(i == ip and t - reach <= u <= t and (inclusive or u > t - reach) for _, i, u in rows) for n, ip, t in rows}
        assert got == want
    assert {x.n for x in recent.blocked(df, ["ip"], "ts", 2).collect()} == {n for n, v in {x.n: x.in_window for x in recent.rate_window(df, ["ip"], "ts", 1.0).collect()}.items() if v > 2}


def test_latest(spark):
    rows = [(n, "s1" if n % 2 else "s2", at(n), "error" if n % 3 else "info", float(n)) for n in range(300)]
    log = spark.createDataFrame(rows, "n int, store string, ts timestamp, level string, duration_ms double")
    assert [r.n for r in recent.latest_events(log, 3).collect()] == [299, 298, 297]
    assert [r.n for r in recent.latest_events(log, 2, "info").collect()] == [297, 294]
    assert len(recent.latest_events(log, 9999).collect()) == 200 and len(recent.latest_events(log, -1).collect()) == 1
    newest = recent.latest_per_key(log, ["store"], ["ts"])
    assert sorted((r.store, r["rank"], r.n) for r in newest.collect()) == sorted([("s1", k + 1, 299 - 2 * k) for k in range(50)] + [("s2", k + 1, 298 - 2 * k) for k in range(50)])
    assert recent.slow_queries(log, 0, ["store"], ["ts"]).count() == 0
    assert {r.n for r in recent.slow_queries(log, 290, ["store"], ["ts"]).collect()} == set(range(290, 300))


def test_busy_keys_are_cut_before_the_shuffle(spark, capsys):
    recent.latest_per_key(spark.range(1000).selectExpr("id % 2 AS k", "id"), ["k"], ["id"]).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan.split("Exchange")[1]


def test_expiry_and_eviction(spark):
    rows = [("a", at(1)), ("b", at(2)), ("c", at(3)), ("a", at(4)), ("b", at(2.5))]
    df = spark.createDataFrame(rows, "id string, ts timestamp")
    assert recent.unexpired(df, "ts", F.lit(at(4)), 1).count() == 2 and recent.unexpired(df, "ts", F.lit(at(9)), 0).count() == 5
    assert [r._id for r in recent.evicted(df, "id", "ts", 2).collect()] == ["b"]
    assert [r._id for r in recent.evicted(df, "id", "ts", 2, "lfu").collect()] == ["c"]


def test_figures(spark):
    rows = [
        (at(1), "s", "read", "u", "http", 1, 2, 0.0, None), (at(2), "s", "READ", "", "ftp", 1, None, 0.0, None), (at(3), "s", "error", "u", "socket", 0, 0, 0.0, "bad"), (at(4), None, "read", "u", "http", 9, 9, 0.0, None),
        (at(5), "s", "rate_limited", "ip", "http", 0, 0, 0.0, None),
    ]
    log = spark.createDataFrame(rows, "ts timestamp, store string, op string, client string, transport string, bytes_in long, bytes_out long, duration_ms double, message string")
    (store,) = metrics.by_store(log).collect()
    assert (store.reads, store.errors, store.rate_limited, store.bytes_in, store.bytes_out) == (2, 1, 1, 2, 2)
    assert {(r.transport, r.reads) for r in metrics.by_transport(log).collect()} == {("http", 2), ("socket", 0)}
    assert {(r.client, r.reads) for r in metrics.by_client(log).collect()} == {("u", 1), ("ip", 0)}
    assert sorted((r.level, r.transport, r.client, r.reads) for r in metrics.breakdown(log).collect() if r.level != "client") == [("store", None, None, 2), ("transport", "http", None, 2), ("transport", "socket", None, 0)]
    stores = spark.createDataFrame([("s",), ("idle",)], "name string")
    assert {(r.store, r.reads, r.bytes_in) for r in metrics.all_stores(stores, log).collect()} == {("s", 2, 2), ("idle", 0, 0)}
    assert [(r.ip, r.n) for r in metrics.limited_clients(log).collect()] == [("ip", 1)]


def test_health():
    specs = [StoreSpec("a"), StoreSpec("b", identity=Identity(length=28, auto_expand=True))]
    assert metrics.health(specs[:1]) == "ok" and metrics.health(specs) == "low"
    assert metrics.health([*specs, StoreSpec("c", identity=Identity(length=33))]) == "degraded"
