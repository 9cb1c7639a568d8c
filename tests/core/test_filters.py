"""Filters against hand-made expectations and against an independent evaluator on random filters."""

import json
import random

import pytest

from tests.core.fixtures import FIELDS, PRODUCTS, PRODUCTS_SCHEMA, documents
from vellum.errors import QueryError
from vellum.functions.text import tokens, tokens_of
from vellum.model import StoreSpec
from vellum.operators import search
from vellum.plans.builder import Q

TYPED = StoreSpec("products", "_id")
TEXT = StoreSpec("products", "_id", {"description": "text", "name": True})


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, PRODUCTS_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bodies(spark):
    rows = [(doc["_id"], json.dumps({k: v for k, v in doc.items() if k != "_id"})) for doc in documents()]
    return spark.createDataFrame(rows, "_id string, body string").cache()


def ids(df, spec, filter_):
    return sorted(row._id for row in search.matching(df, spec, {"filter": filter_}).select("_id").collect())


CASES = [
    ({"category": {"neq": "deals"}}, "p1 p4 p5"), ({"category": {"nin": ["deals"]}}, "p1 p4 p5"), ({"price": {"exists": True}}, "p1 p2 p3 p5"),
    ({"deleted_at": {"exists": False}}, "p1 p2 p4 p5"), ({"tags": {"exists": False}}, "p2 p3"), ({"name": {"contains": "steel"}}, "p1 p5"),
    ({"price": {"gte": 4.99, "lt": 10}}, "p1 p2"), ({"category": None}, ""), ({"category": {"eq": None}}, "p5"), ({"$or": []}, ""), ({}, "p1 p2 p3 p4 p5"), ([], "p1 p2 p3 p4 p5"),
    ({"price": {}}, "p1 p2 p3 p4 p5"), ({"$and": []}, "p1 p2 p3 p4 p5"), ({"$or": ["x", {"year": 2020}]}, "p1 p5"), ({"nothing": 3}, ""), ({"nothing": {"neq": 3}}, "p1 p2 p3 p4 p5"),
    ({"in_stock": 1}, "p1 p4"), ({"in_stock": False}, "p2 p5"), ({"year": {"in": [2020.0, 2019]}}, "p1 p4 p5"), ({"year": "2020"}, ""), ({"year": {"neq": "2020"}}, "p1 p2 p3 p4 p5"),
    ({"category": {"in": [None, "deals"]}}, "p2 p3 p5"), ({"category": {"nin": [None, "deals"]}}, "p1 p4"), ({"tags": {"eq": ["b"]}}, "p5"), ({"tags": {"eq": []}}, "p2"), ({"tags": {"neq": ["b"]}}, "p1 p2 p3 p4"),
    ({"tags": {"in": [["b"], ["a", "b"]]}}, "p1 p5"), ({"price": {"contains": "9"}}, ""), ({"_id": "p3"}, "p3"), ({"_id": {"in": ["p1", "zz"]}}, "p1"), ({"id": "p2"}, "p2"), ({"name": ["Widget", "a"]}, "p2 p3"),
    ({"year": {"gt": 2019, "unknown": 1}, "$or": [{"price": {"lt": 5}}, {"$and": [{"category": "deals"}, {"year": 2025}]}]}, "p2 p3 p5"), ({"name": {"gt": "Steel"}}, "p1 p2 p3"),
]


@pytest.mark.parametrize("filter_, want", CASES, ids=[json.dumps(c[0])[:50] for c in CASES])
def test_typed(products, filter_, want):
    assert ids(products, TYPED, filter_) == want.split()


@pytest.mark.parametrize("kind", ["json", "variant"])
def test_schemaless_agrees_with_typed(bodies, kind):
    from pyspark.sql import functions as F

    df = bodies if kind == "json" else bodies.withColumn("body", F.parse_json("body"))
    spec = StoreSpec("products", "_id", doc="body")
    for filter_, want in CASES:
        if filter_ != {"id": "p2"}:
            assert ids(df, spec, filter_) == want.split(), filter_


@pytest.mark.parametrize("filter_, want", [
    ({"description": {"contains": "engine replacement"}}, "p1"), ({"description": ["engine"]}, "p1 p2"), ({"description": ["the"]}, ""), ({"description": ["product"]}, ""), ({"description": []}, ""),
    ({"description": ["Engine, replacement"]}, "p1 p2 p5"), ({"description": ["engine", "replacement"]}, "p1"), ({"description": {"contains": "the"}}, ""), ({"name": "a"}, "p3"), ({"description": {"neq": "x"}}, "p1 p2 p3 p4 p5"),
])
def test_text_mode(products, bodies, filter_, want):
    assert ids(products, TEXT, filter_) == want.split()
    assert ids(bodies, TEXT.changed(doc="body"), filter_) == want.split()


@pytest.mark.parametrize("filter_", [
    {"$or": {"a": 1}}, {"price": {"in": "x"}}, {"price": {"gt": "x"}}, {"name": {"lt": 3}}, {"name": {"gt": None}}, {"name": {"contains": 3}}, {"description": ["a", 3]}, {"tags": {"gt": ["a"]}},
])
def test_errors(products, filter_):
    with pytest.raises(QueryError):
        ids(products, TEXT, filter_)


def test_depth_limit(products):
    deep = {"year": 2020}
    for _ in range(5):
        deep = {"$and": [deep]}
    assert ids(products, TYPED, deep) == ["p1", "p5"]
    for _ in range(8):
        deep = {"$or": [deep]}
    with pytest.raises(QueryError, match="12 levels"):
        ids(products, TYPED, deep)


def test_nested_paths(spark):
    rows = [("u1", '{"user":{"profile":{"age":25}}}'), ("u2", '{"user":{"profile":{"age":20}}}'), ("u3", '{"user":"x"}'), ("u4", '{"user.profile.age":30}'), ("u5", "no json"), ("u6", None)]
    df = spark.createDataFrame(rows, "_id string, body string")
    filter_ = {"user.profile.age": {"gte": 21}}
    assert ids(df, StoreSpec("u", "_id", doc="body", nested=True), filter_) == ["u1"]
    assert ids(df, StoreSpec("u", "_id", doc="body"), filter_) == ["u4"]
    typed = spark.createDataFrame([("u1", (25,), 1), ("u2", (20,), 40)], "_id string, user struct<age:int>, `user.age` int")
    assert ids(typed, StoreSpec("u", "_id", nested=True), {"user.age": {"gte": 21}}) == ["u1"]
    assert ids(typed, StoreSpec("u", "_id"), {"user.age": {"gte": 21}}) == ["u2"]


def test_numeric_mode_reads_text(spark):
    df = spark.createDataFrame([("a", "10"), ("b", "9.5"), ("c", "x"), ("d", None)], "_id string, v string")
    numeric, plain = StoreSpec("s", "_id", {"v": "numeric"}), StoreSpec("s", "_id")
    assert ids(df, numeric, {"v": {"gt": 9}}) == ["a", "b"] and ids(df, numeric, {"v": 10}) == ["a"] and ids(df, numeric, {"v": {"lte": "9.5"}}) == ["b"]
    assert ids(df, plain, {"v": 10}) == []
    with pytest.raises(QueryError):
        ids(df, numeric, {"v": {"gt": "many"}})


def evaluate(doc, filter_):
    """An independent reading of the filter language, for plain (exact) fields."""
    if isinstance(filter_, list):
        return all(evaluate(doc, x) for x in filter_)
    if not isinstance(filter_, dict):
        return False
    for name, value in filter_.items():
        if name == "$or":
            good = any(evaluate(doc, x) for x in value)
        elif name == "$and":
            good = evaluate(doc, value)
        elif isinstance(value, dict):
            good = all(test(doc.get(name), op, operand) for op, operand in value.items())
        else:
            good = doc.get(name) in value if isinstance(value, list) else value is not None and doc.get(name) == value
        if not good:
            return False
    return True


def test(value, op, operand):
    if op in ("gt", "gte", "lt", "lte"):
        return value is not None and {"gt": value > operand, "gte": value >= operand, "lt": value < operand, "lte": value <= operand}[op]
    if op == "contains":
        return isinstance(value, str) and operand.lower() in value.lower()
    if op == "exists":
        return (value not in (None, "", [])) == bool(operand)
    return {"eq": lambda: value == operand, "neq": lambda: value != operand, "in": lambda: value in operand, "nin": lambda: value not in operand}[op]()


test.__test__ = False


def random_filter(r, depth=0):
    pick = r.random()
    if depth < 3 and pick < 0.25:
        return {r.choice(["$or", "$and"]): [random_filter(r, depth + 1) for _ in range(r.randrange(0, 4))]}
    values = {name: [row[k + 1] for row in PRODUCTS] for k, name in enumerate(FIELDS)}
    out = {}
    for name in r.sample(FIELDS, r.choice([1, 1, 2])):
        any_value = lambda: r.choice(values[r.choice(FIELDS)] if r.random() < 0.2 else values[name])
        ordered = [v for v in values[name] if v is not None and not isinstance(v, list | bool)]
        ops = {"eq": any_value, "neq": any_value, "exists": lambda: r.random() < 0.5, "contains": lambda: r.choice(["steel", "B", "e"]), "in": lambda: [any_value() for _ in range(2)], "nin": lambda: [any_value() for _ in range(2)]}
        if ordered:
            ops |= {op: lambda: r.choice(ordered) for op in ("gt", "gte", "lt", "lte")}
        out[name] = {op: ops[op]() for op in r.sample(sorted(ops), r.choice([1, 1, 2]))} if r.random() < 0.8 else any_value()
    return out


def test_random_filters(products, bodies):
    r = random.Random(11)
    docs = documents()
    body_spec = StoreSpec("products", "_id", doc="body")
    for n in range(120):
        filter_ = random_filter(r)
        want = sorted(d["_id"] for d in docs if evaluate(d, filter_))
        assert ids(products, TYPED, filter_) == want, filter_
        if n % 3 == 0:
            assert ids(bodies, body_spec, filter_) == want, filter_


def test_order_and_pages(products):
    page = lambda q: [row._id for row in search.page(products, TYPED, q).collect()]
    assert page(Q().sort("+price")) == ["p4", "p5", "p2", "p1", "p3"]
    assert page(Q().sort("-price")) == ["p3", "p1", "p2", "p5", "p4"]
    assert page(Q().sort("price").limit(2).offset(1)) == ["p5", "p2"]
    assert page(Q().limit(0)) == [] and page(Q().sort("+-nothing")) == ["p1", "p2", "p3", "p4", "p5"]
    assert sum((page(Q().sort("-year").limit(2).offset(k)) for k in (0, 2, 4)), []) == page(Q().sort("-year"))
    assert page({"year": 2020, "limit": 1, "store": "x", "hydrate": True}) == ["p1"]
    with pytest.raises(QueryError):
        page("x")
    with pytest.raises(QueryError):
        page({"filter": {}, "limit": "many"})


def test_results(products):
    spec = TYPED.changed(default_limit=2)
    result = search.run_query(products, spec, {"filter": {}, "sort": "price"})
    assert result.ids == ["p4", "p5"] and result.total_matches == 5 and len(result) == 2 and bool(result)
    full = search.run_query(products, spec, Q.field("year").eq(2020).build(), hydrate=True)
    assert [r["name"] for r in full] == ["Steel Bolt", "STEEL bolt"] and "ids" not in full.payload() and full.payload()["total_matches"] == 2
    assert search.point_read(products, TYPED, "p2").name == "Widget" and search.point_read(products, TYPED, "zz") is None
    assert search.exists(products, TYPED, "p1") and not search.exists(products, TYPED, "p9")
    assert sorted(r._id for r in search.multi_read(products, TYPED, ["p1", "p4", "x"] + [f"q{i}" for i in range(2000)]).collect()) == ["p1", "p4"]


def test_builder():
    q = (Q.field("a").gte(1) & Q.field("b").contains("x")).sort("-a").limit(0).offset(2)
    assert q.build() == {"filter": {"$and": [{"a": {"gte": 1}}, {"b": {"contains": "x"}}]}, "sort": "-a", "limit": 0, "offset": 2}
    assert (Q.field("a").not_included([1]).limit(3) | Q.where("b", "lt", 2)).build() == {"filter": {"$or": [{"a": {"nin": [1]}}, {"b": {"lt": 2}}]}}


def test_tokens(spark):
    cases = {
        "ecommerce.product": ["ecommerce.product"], "Hello, world.": ["hello", "world"], "Mr. Smith": ["mr", "smith"], "--__foo__--": ["foo"], "x yy zz": ["yy", "zz"], "the is a": [], "": [],
        "a bb cc\x1cdd　ee": ["bb", "cc", "dd", "ee"], "ÄÖ Straße": ["äö", "straße"], "it's (o.k.) bb bb": ["it's", "o.k", "bb", "bb"],
    }
    from pyspark.sql import functions as F

    got = {r.t: r.tok for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", tokens(F.col("t")).alias("tok")).collect()}
    assert got == cases == {t: tokens_of(t) for t in cases}


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "cast(id % 7 as int) as v", "cast(id as string) as s").write.parquet(path)
    df = spark.read.parquet(path)
    spec = StoreSpec("t", "id")
    search.matching(df, spec, {"filter": {"v": {"gte": 2, "neq": 4}, "s": {"in": ["1", "2"]}, "_id": "9"}}).select("v").explain("formatted")
    pushed = capsys.readouterr().out.split("PushedFilters:")[-1].split("\n")[0]
    assert all(x in pushed for x in ("GreaterThanOrEqual(v,2)", "EqualNullSafe(v,4)", "In(s", "EqualTo(id,9)"))
    search.page(df, spec, Q().sort("-v").limit(3)).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_timeout(spark):
    from pyspark.sql import functions as F

    from vellum.errors import QueryTimeout

    slow = spark.range(0, 6_000_000, 1, 4).select(F.col("id").cast("string").alias("_id"), F.sha2(F.sha2(F.col("id").cast("string"), 512), 512).alias("v"))
    with pytest.raises(QueryTimeout):
        search.run_query(slow, StoreSpec("slow", "_id", timeout_ms=300), {"filter": {"v": "x"}})


def test_negations_on_times(spark):
    """A text that is no time equals nothing; null differs from every value."""
    import datetime

    from vellum.model import StoreSpec
    from vellum.operators import search

    days = [datetime.date(2024, 1, d) for d in (1, 2, 3)]
    rows = [(k, None if d is None else datetime.datetime(d.year, d.month, d.day), d) for k, d in enumerate([*days, None])]
    df = spark.createDataFrame(rows, "id long, ts timestamp, day date")
    pool = ["garbage", "2024-01-01", "2024-01-02", "2024-13-45", ""]
    when = {"2024-01-01": days[0], "2024-01-02": days[1]}
    for field in ("ts", "day"):
        for mask in range(2 ** len(pool)):
            values = [v for k, v in enumerate(pool) if mask >> k & 1]
            known = {when[v] for v in values if v in when}
            for extra in ([], [None]):
                found = {r.id for r in search.matching(df, StoreSpec("t", "id"), {"filter": {field: {"nin": values + extra}}}).collect()} if mask % 3 == 0 else None
                if found is not None:
                    assert found == {k for k, _, d in rows if d not in known and not (d is None and extra)}, (field, values, extra)
        for v in pool:
            assert {r.id for r in search.matching(df, StoreSpec("t", "id"), {"filter": {field: {"neq": v}}}).collect()} == {k for k, _, d in rows if d != when.get(v, 0)}
            assert {r.id for r in search.matching(df, StoreSpec("t", "id"), {"filter": {field: {"eq": v}}}).collect()} == {k for k, _, d in rows if d is not None and d == when.get(v)}
