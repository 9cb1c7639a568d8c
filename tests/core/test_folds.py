"""Folds of a log against a plain reading of its meaning, and what is built on them."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions.patches import History, applied, composed, flat, patch_of, read_delta, spread
from vellum.operators import fold

OPS = [
    (1, "u1", "write", '{"settings":{"theme":"dark","notifications":true}}'), (2, "u1", "write", '{"settings.theme":"light","settings.notifications":null}'), (3, "u2", "write", '{"a":1,"b":2}'),
    (4, "u2", "delete", None), (5, "u2", "write", '{"b":3}'), (6, "u3", "write", '{"a":{"x":1}}'), (7, "u3", "write", '{"a":{"y":2}}'), (8, "u4", "delete", None), (9, "u5", "write", "no json"),
    (10, "u6", "write", "{}"), (11, None, "write", '{"a":1}'), (12, "u7", "touch", '{"a":1}'), (13, "u8", "write", '{"a":1}'), (14, "u8", "delete", None),
]


def ops_of(spark, rows):
    return spark.createDataFrame([(*row, "x") for row in rows], f"{fold.OPS}, doc string").repartition(3)


def docs_of(df):
    return {row._id: json.loads(row.doc) for row in df.collect()}


def test_shallow(spark):
    got = docs_of(fold.fold_shallow(ops_of(spark, OPS)))
    assert got == {"u1": {"settings": {"theme": "dark", "notifications": True}, "settings.theme": "light", "settings.notifications": None}, "u2": {"b": 3}, "u3": {"a": {"y": 2}}, "u6": {}}


def test_deep(spark):
    got = docs_of(fold.fold_deep(ops_of(spark, OPS)))
    assert got == {"u1": {"settings": {"theme": "light"}}, "u2": {"b": 3}, "u3": {"a": {"x": 1, "y": 2}}, "u6": {}}


def test_dead_letters(spark):
    ops = ops_of(spark, OPS)
    assert sorted(r.seq for r in ops.where(~fold.wellformed()).collect()) == [9, 11, 12]


@pytest.mark.parametrize("nested", [False, True])
def test_empty_log(spark, nested):
    assert fold.fold(ops_of(spark, []), nested).collect() == []


def random_value(r, depth=0):
    pick = r.random()
    if depth < 3 and pick < 0.45:
        return {r.choice("abc"): random_value(r, depth + 1) for _ in range(r.randrange(0, 3))}
    return r.choice([None, None, 1, 2.5, "x", 'quo"te', [1, {"a": None}], True, "é"])


def random_log(r, n):
    rows = []
    for seq in range(n):
        id_ = "busy" if r.random() < 0.4 else f"k{r.randrange(6)}"
        if r.random() < 0.06:
            rows.append((seq, id_, "delete", None))
            continue
        delta = {r.choice(["a", "b", "c", "a.b", "b.c.a", "d"]): random_value(r) for _ in range(r.randrange(0, 3))}
        rows.append((seq, id_, "write", json.dumps(delta)))
    return rows


def merge(doc, delta):
    """A deep merge into ``doc``, in place."""
    for key, value in delta.items():
        if value is None:
            doc.pop(key, None)
        elif isinstance(value, dict) and isinstance(doc.get(key), dict):
            merge(doc[key], value)
        else:
            doc[key] = copy.deepcopy(value)


def brute(rows, nested):
    state = {}
    for _, id_, op, delta in sorted(rows):
        if op == "delete":
            state.pop(id_, None)
            continue
        body = read_delta(delta, nested)
        if body is None:
            continue
        doc = state.setdefault(id_, {})
        merge(doc, body) if nested else doc.update(body)
    return state


@pytest.mark.parametrize("nested", [False, True])
@pytest.mark.parametrize("seed", [3, 4])
def test_random_logs(spark, nested, seed):
    rows = random_log(random.Random(seed), 400)
    if not nested:
        rows = [row for row in rows if row[3] is None or json.loads(row[3]) is not None]
    ops = ops_of(spark, rows)
    assert docs_of(fold.fold(ops, nested)) == brute(rows, nested)
    if seed == 3:
        assert docs_of(fold.fold(fold.compacted(ops, nested), nested)) == brute(rows, nested)


def test_patches_compose():
    r = random.Random(8)
    for _ in range(3000):
        doc, first, then = ({r.choice("abc"): random_value(r) for _ in range(3)} for _ in range(3))
        p, q = patch_of(first), patch_of(then)
        want = copy.deepcopy(doc)
        merge(want, first)
        merge(want, then)
        assert applied(doc, composed(p, q)) == applied(applied(doc, p), q) == want
        h = History.loads(History(True, True, composed(p, q)).dumps())
        assert h.document() == applied({}, composed(p, q))


def test_spread_and_flat():
    assert spread({"a.b": 1, "a.c": 2, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3}
    with pytest.raises(ValueError):
        spread({"a": 1, "a.b": 2})
    assert flat({"a": {"b": 1, "c": {"d": [1]}}, "e": {}}) == {"a.b": 1, "a.c.d": [1]}
    assert read_delta("[1]") is None and read_delta(None) is None and read_delta("{") is None


def test_diff(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("e", 5)], "k string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4), ("d", None)], "k string, v int")
    got = sorted(tuple(r) for r in fold.diff(before, after, ["k"], "v").collect())
    assert got == [("b", 2, 3, "changed"), ("c", None, 4, "changed"), ("d", None, None, "added"), ("e", 5, None, "removed")]


def test_flatten_and_nest(spark):
    df = spark.createDataFrame([(1, ("x", (2.5, [1])))], "a int, b struct<c:string,d:struct<e:double,f:array<int>>>")
    wide = df.select(*fold.flatten_columns(df.schema))
    assert wide.columns == ["a", "b.c", "b.d.e", "b.d.f"]
    assert wide.select(*fold.nest_columns(wide.columns)).collect() == df.collect()


def test_debounce_boundary(spark):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:05"), (3, "a", "2024-01-01 00:00:10.000001"), (4, "b", "2024-01-01 00:00:03")]
    ops = spark.createDataFrame(rows, "seq long, _id string, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = sorted((r._id, r.n_writes, r.first_seq, r.last_seq) for r in fold.debounced(ops).collect())
    assert got == [("a", 1, 3, 3), ("a", 2, 1, 2), ("b", 1, 4, 4)]


def test_segments_worth_rewriting(spark):
    entries = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 2, 10), (2, "a", 3, 5), (3, "c", 4, 7), (4, "c", 5, 7)], "segment int, _id string, seq int, size int")
    got = {r.segment: (r.physical, r.logical, r.compact) for r in fold.dead_ratio(entries).collect()}
    assert got == {1: (20, 10, True), 2: (5, 5, False), 3: (7, 0, False), 4: (7, 7, False)}
    assert [r._id for r in fold.segment_members(entries, 2).collect()] == ["a"]


def test_debounce_matches_plain_reading(spark):
    r = random.Random(5)
    at, rows = 0.0, []
    for seq in range(1500):
        at += r.choice([0.0, 0.5, 1.0, 1.000001, 3.0, 40.0])
        rows.append((seq, r.choice("aab"), at))
    ops = spark.createDataFrame(rows, "seq long, _id string, at double").select("seq", "_id", F.timestamp_micros(F.round(F.col("at") * 1e6).cast("long")).alias("ts"))
    want = []
    for id_ in "ab":
        flush = []
        for seq, _, t in sorted(x for x in rows if x[1] == id_):
            if flush and round((t - flush[-1][1]) * 1e6) > 1_000_000:
                want.append((id_, len(flush), flush[0][0], flush[-1][0]))
                flush = []
            flush.append((seq, t))
        want.append((id_, len(flush), flush[0][0], flush[-1][0]))
    got = [(x._id, x.n_writes, x.first_seq, x.last_seq) for x in fold.debounced(ops, 1.0).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
