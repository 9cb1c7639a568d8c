"""The facade, its command line, log segments, and the streams."""

import json

import pytest
from pyspark.sql import functions as F

from tests.core.fixtures import PRODUCTS, PRODUCTS_SCHEMA
from vellum.__main__ import _parser, run
from vellum.engine import Engine
from vellum.errors import EngineError, QueryError, RecordNotFound, StoreExists, StoreNotFound
from vellum.model import Identity, StoreSpec
from vellum.operators import access, fold, index
from vellum.plans.builder import Q
from vellum.sources import audit, segments
from vellum.streaming import feed


def test_managed_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_store(StoreSpec("users", nested=True))
    seen = []
    engine.on_update("users", seen.append)
    engine.set("users", "u1", {"name": "Ann", "settings": {"theme": "dark", "on": True}})
    engine.set("users", "u1", {"settings.theme": "light", "settings.on": None})
    new = engine.insert("users", {"name": "Bo", "age": 7})
    assert len(new) == 16 and engine.get("users", "u1") == {"_id": "u1", "name": "Ann", "settings": {"theme": "light"}}
    engine.compact("users")
    engine.set("users", "u1", {"age": 30})
    engine.delete("users", "nobody")
    assert engine.query("users", Q.field("settings.theme").eq("light")).ids == ["u1"]
    result = engine.query("users", {"filter": {"age": {"gt": 1}}, "sort": "-age"}, hydrate=True)
    assert [r["name"] for r in result.records] == ["Ann", "Bo"] and result.total_matches == 2
    assert engine.patch("users", "u1", {"a": 1, "b": {"c": 2}}, {"a": 1, "b": {"d": 3}}) == {"b.d": 3, "b.c": None} and engine.patch("users", "u1", {"a": 1}, {"a": 1}) is None
    engine.delete("users", new)
    with pytest.raises(RecordNotFound):
        engine.get("users", new)
    assert engine.count("users") == 1 and engine.exists("users", "u1") and set(engine.multi_get("users", ["u1", new])) == {"u1"}
    assert [e["op"] for e in seen] == ["write", "write", "write", "write", "delete", "write", "delete"]
    engine.write_many("users", spark.createDataFrame([("m1", '{"v":1}'), ("m2", '{"v":2}')], "_id string, delta string"))
    assert engine.submit("count", "users").result() == 3
    assert engine.discover_fields("users") == ["age", "b", "name", "settings", "v"]
    other = Engine(spark, str(tmp_path))
    assert other.open_store("users").nested and other.count("users") == 3
    with pytest.raises(StoreExists):
        other.create_store(StoreSpec("users"))
    other.drop_store("users")
    with pytest.raises(StoreNotFound):
        other.count("users")


def test_requests(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register(StoreSpec("products", "_id", slow_query_ms=0.001), spark.createDataFrame(PRODUCTS, PRODUCTS_SCHEMA))
    assert engine.execute("ping")["data"] == "pong"
    assert engine.execute("list_stores")["data"] == [{"name": "products", "record_count": 5}]
    assert engine.execute("read", "products", {"record_id": "p1"}, "u")["data"]["name"] == "Steel Bolt"
    assert engine.execute("read", "products", {"record_id": "zz"})["code"] == 404 and engine.execute("read", "products", {})["code"] == 400
    assert engine.execute("query", "none", {})["code"] == 404 and engine.execute("fly", "products")["code"] == 400 and engine.execute("write", "products", {"record_id": "x", "delta": 3})["code"] == 400
    page = engine.execute("query", "products", {"filter": {"year": 2020}, "hydrate": True})["data"]
    assert page["count"] == 2 and "ids" not in page
    figures = engine.metrics("products")
    store = figures["store"].first()
    assert (store.reads, store.queries, store.errors) == (1, 1, 4) and figures["slow"].count() == 1 and figures["errors"].count() == 4
    engine.reset_metrics("products")
    assert engine.metrics("products")["store"].count() == 0
    engine.configure("products", default_limit=1)
    assert len(engine.query("products", {})) == 1 and engine.export_config("products")["default_limit"] == 1
    with pytest.raises(StoreExists):
        engine.register(StoreSpec("products"), spark.range(1))
    with pytest.raises(QueryError):
        StoreSpec("x", fields={"a": "fuzzy"})


def test_identity(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.register(StoreSpec("one", "_id", identity=Identity("a", 1)), spark.createDataFrame([("a",)], "_id string"))
    with pytest.raises(EngineError):
        engine.generate_id("one", attempts=2)
    engine.configure("one", identity=Identity("a", 1, auto_expand=True))
    assert engine.generate_id("one", attempts=1) == "aa"


def test_command_line(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_store(StoreSpec("s"))
    do = lambda *words: run(engine, _parser().parse_args([str(tmp_path), *words]))
    assert do("set", "s", "a", '{"v": 1}')["ok"] and do("get", "s", "a")["data"] == {"_id": "a", "v": 1}
    assert do("query", "s", '{"filter": {"v": 1}}')["data"]["ids"] == ["a"] and not do("get", "nope", "a")["ok"]
    assert run(Engine(spark, str(tmp_path)), _parser().parse_args([str(tmp_path), "list-stores"]))["data"] == [{"name": "s", "record_count": 1}]


def test_segments(spark, tmp_path):
    (tmp_path / "products_001.log").write_text('a {"n": 1}\nb {"n": 2}\n\n[1]\n')
    (tmp_path / "products_002.log").write_text('a {"n": 3}\nbad\nc [1]\n')
    lines = segments.read_segments(spark, str(tmp_path))
    assert {r._id: json.loads(r.doc) for r in segments.current_versions(lines).collect()} == {"a": {"n": 3}, "b": {"n": 2}}
    assert segments.read_segments(spark, str(tmp_path), keep_malformed=True).where("_id IS NULL").count() == 4
    docs = spark.createDataFrame([(f"k{i}", json.dumps({"v": i, "t": "a b"})) for i in range(50)], "_id string, doc string")
    segments.write_segments(docs, str(tmp_path / "out"), lines_per_file=10)
    back = segments.current_versions(segments.read_segments(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    with pytest.raises(QueryError):
        segments.write_segments(spark.createDataFrame([("a b", "{}")], "_id string, doc string"), str(tmp_path / "no"))
    (tmp_path / "log.jsonl").write_text('{"time": 1, "ip": "a"}\n{"time": 3, "ip": "b"}\n{"time": 2, "ip": "c"}\n')
    assert [r.ip for r in segments.read_json_log(spark, str(tmp_path / "log.jsonl"), "time long, ip string", 2).collect()] == ["b", "c"]


def test_segments_in_order_of_their_numbers(spark, tmp_path):
    docs = spark.createDataFrame([("a", f'{{"n":{n}}}') for n in range(1002)], "_id string, doc string").coalesce(1)
    segments.write_segments(docs, str(tmp_path / "many"), lines_per_file=1)  # c999 comes before c1000
    assert [r.doc for r in segments.current_versions(segments.read_segments(spark, str(tmp_path / "many"))).collect()] == ['{"n":1001}']
    names = ["a", "s0_9", "s1", "s1_2", "s01_10", "s2.b", "s10", "s99999999999999999999999", "s100000000000000000000000", "x-00000-1", "x-00000-02", "x-100000-0"]
    ordered = spark.createDataFrame([(x,) for x in names], "name string").orderBy(segments.name_order(F.col("name")))
    assert [r.name for r in ordered.collect()] == names


def test_streams_equal_batch_folds(spark, tmp_path):
    rows = [(i, f"k{i % 4}", "delete" if i % 11 == 7 else "write", None if i % 11 == 7 else json.dumps({f"f{i % 3}": i})) for i in range(60)] + [(99, "k1", "write", "broken")]
    for part in range(3):
        spark.createDataFrame([(*row, "2024-01-01 00:00:00") for row in rows[part::3]], f"{fold.OPS}, ts string").write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema(f"{fold.OPS}, ts string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    folder = str(tmp_path / "out")
    feed.log_operations(stream, folder, f"{folder}/checkpoint").awaitTermination()
    logged = feed.read_batches(spark, folder, "ops", fold.OPS)
    whole = spark.createDataFrame(rows, fold.OPS)
    docs = lambda df: {r._id: json.loads(r.doc) for r in fold.fold_shallow(df).collect()}
    assert docs(logged) == docs(whole) and feed.read_batches(spark, folder, "dead_letters", fold.OPS).count() == 1
    changes = []
    feed.subscribe(stream, "s", lambda df, n: changes.extend(df.collect()), str(tmp_path / "feed"), once=True).awaitTermination()
    assert sorted((c.record_id, c.op) for c in changes) == sorted((r[1], r[2]) for r in rows)


def test_debounced_stream(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:03"), (3, "b", "2024-01-01 00:01:00"), (4, "a", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "seq long, _id string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, _id string, ts timestamp").parquet(str(tmp_path / "in"))
    query = feed.debounced_stream(stream).writeStream.format("memory").queryName("flushes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r._id, r.n_writes) for r in spark.table("flushes").collect()} == {("a", 2), ("b", 1)}


def test_audit(spark, tmp_path):
    for name in ("a", "b", "c"):
        (tmp_path / f"{name}.log").write_text(name * 10)
    before = spark.createDataFrame(audit.manifest(spark, str(tmp_path), "*.log").collect())
    (tmp_path / "b.log").write_text("b" * 9 + "x")
    (tmp_path / "c.log").unlink()
    found = audit.damaged(before, audit.manifest(spark, str(tmp_path), "*.log")).collect()
    assert {(r.path.rsplit("/", 1)[1], r.state) for r in found} == {("b.log", "changed"), ("c.log", "missing")}


def test_fields_of_a_batch(spark):
    batch = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}',), ("[1]",), (None,), ('{"d": null}',)], "body string")
    known = spark.createDataFrame([("a",)], "field string")
    assert sorted(r.field for r in index.new_fields(batch, known, "body").collect()) == ["b", "d"]
    assert "a: BIGINT" in index.merged_schema(batch.where("body like '{%'"), "body").first().schema


def test_bulk_ids(spark):
    rows = spark.range(2000).withColumnRenamed("id", "n")
    got = access.with_new_ids(rows, Identity(length=1), spark.createDataFrame([("a",)], "_id string"), 3).collect()
    assert len(got) == 2000 and all(r._id is None or (len(r._id) == 1 and r._id != "a") for r in got) and any(r._id is None for r in got)


def test_postings_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(str(n), f"common word{n % 5} {'rare' if n == 7 else ''}") for n in range(40)], "_id string, text string")
    path = str(tmp_path / "postings")
    index.write_postings(index.postings(docs, F.col("_id"), F.col("text")), path, files=3)
    posted = spark.read.parquet(path)
    ids = lambda *a, **k: sorted(int(r._id) for r in index.search_postings(posted, *a, **k).collect())
    assert ids(["common", "word1"]) == list(range(1, 40, 5)) and ids(["rare", "word1"], mode="or") == sorted({7, *range(1, 40, 5)})
    assert ids(["rare word3"]) == sorted({7, *range(3, 40, 5)}) and ids([]) == [] == ids(["the"]) and ids(["the", "rare"]) == []
    assert {r.token: r.n_records for r in index.posting_sizes(posted).collect()}["common"] == 40


def test_index_is_built_in_one_pass(spark, tmp_path):
    cut = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            cut.add(batch.num_rows)
            yield batch

    rows = [(str(n), f"common word{n % 5}" if n % 7 else None) for n in range(40)] + [("none", "the"), ("empty", "")]
    docs = spark.createDataFrame(rows, "_id string, text string").repartition(3).mapInArrow(counted, "_id string, text string")
    path = str(tmp_path / "index")
    index.write_index(index.postings(docs, F.col("_id"), F.col("text")), path)
    assert cut.value == len(rows)  # a shuffle by ranges reads them once more for its borders
    stored = spark.read.parquet(path)
    assert sorted(map(tuple, stored.collect())) == sorted((token, id_) for id_, text in rows for token in (text or "").split() if token != "the")
    for file in (tmp_path / "index").glob("*.parquet"):
        tokens = [r[0] for r in spark.read.parquet(str(file)).collect()]
        assert tokens == sorted(tokens)


def test_compaction_frees_what_it_covers(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_store(StoreSpec("log"))
    folders = lambda kind: [p.name for p in (tmp_path / "stores" / "log" / kind).glob("*=*")]
    for n in range(3):
        engine.set("log", f"r{n}", {"v": n})
    engine.compact("log")
    assert len(folders("ops")) == 3 and len(folders("base")) == 1
    engine.set("log", "r0", {"v": 9})
    engine.compact("log")
    engine.compact("log")
    assert len(folders("ops")) == 1 and len(folders("base")) == 2
    engine.delete("log", "r1")
    assert {k: r["v"] for k, r in engine.multi_get("log", ["r0", "r1", "r2"]).items()} == {"r0": 9, "r2": 2}
    engine.compact("log")
    assert len(folders("ops")) == 1 and len(folders("base")) == 2 and engine.count("log") == 2


def test_buffered_writes_are_appended_together(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path))
    engine.create_store(StoreSpec("log"))
    appended = []
    monkeypatch.setattr(Engine, "_append", lambda self, name, ops, f=Engine._append: (appended.append(ops.count()), f(self, name, ops))[1])
    monkeypatch.setattr("vellum.engine.WRITES_HELD", 4)
    with engine.buffered("log"):
        for n in range(6):
            engine.set("log", f"r{n % 3}", {"v": n})
        engine.delete("log", "r1")
    assert appended == [4, 3] and {r["_id"]: r["v"] for r in engine.multi_get("log", ["r0", "r1", "r2"]).values()} == {"r0": 3, "r2": 5}
    with pytest.raises(RuntimeError), engine.buffered("log"):
        engine.set("log", "r9", {"v": 1})
        raise RuntimeError
    assert engine.exists("log", "r9")


def test_index_of_a_managed_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_store(StoreSpec("notes", fields={"body": "text"}))
    with engine.buffered("notes"):
        engine.set("notes", "a", {"body": "Steel bolts, and NUTS."})
        engine.set("notes", "b", {"body": "wooden nuts", "n": 3})
        engine.set("notes", "c", {"n": 5})
    filters = [{"body": ["nuts"]}, {"body": {"contains": "the steel nuts"}}, {"body": {"contains": "the"}}, {"body": []}, {"body": ["nuts", "wooden steel"]}, {"$or": [{"body": ["bolts"]}, {"n": {"gt": 4}}]}, {"body": {"contains": "nuts", "neq": "wooden nuts"}}]
    scanned = [engine.query("notes", {"filter": f}).ids for f in filters]
    engine.build_index("notes", "body", str(tmp_path / "postings"))
    assert [engine.query("notes", {"filter": f}).ids for f in filters] == scanned == [["a", "b"], ["a"], [], [], ["a", "b"], ["a", "c"], ["a"]]
    plan = engine.df("notes")
    from vellum.operators import search

    assert "In(__token, [steel,wooden])" in search.matching(plan, engine.spec("notes"), {"filter": filters[4]})._jdf.queryExecution().toString()
    engine.set("notes", "d", {"body": "new nuts"})
    assert engine.query("notes", {"filter": filters[0]}).ids == ["a", "b", "d"]


def test_requests_kept_are_bounded(spark, monkeypatch):
    monkeypatch.setattr("vellum.engine.REQUESTS_KEPT", 5)
    engine = Engine(spark)
    engine.register(StoreSpec("products", "_id"), spark.createDataFrame(PRODUCTS, PRODUCTS_SCHEMA))
    for _ in range(8):
        engine.execute("exists", "products", {"record_id": "p1"})
    assert engine.requests().count() == 5
