"""One query for each operator over the test tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.text import EDGE_SIGNS, SPACE_CLASS, STOP_WORDS, tokens
from vellum.model import Identity, StoreSpec
from vellum.operators import access, fold, index, metrics, recent, search
from vellum.plans.builder import Q
from vellum.plans.filters import record_id
from vellum.sources import audit, segments
from vellum.sources.storage import read, scratch
from vellum.streaming import feed

Query = Callable[[SparkSession, str], DataFrame]

#: Stores over the test tables. ``lineitem`` has no key, so its ids are hashes of rows.
SPECS = {
    spec.name: spec
    for spec in (
        StoreSpec("region", "r_regionkey"), StoreSpec("nation", "n_nationkey"), StoreSpec("customer", "c_custkey"), StoreSpec("supplier", "s_suppkey"),
        StoreSpec("part", "p_partkey", {"p_name": "text", "p_size": "numeric"}), StoreSpec("orders", "o_orderkey"), StoreSpec("lineitem"),
        StoreSpec("events", "event_id", doc="props", nested=True), StoreSpec("documents", "doc_id", {"text": "text"}), StoreSpec("embeddings", "vec_id"),
        StoreSpec("pages", "page_id"), StoreSpec("benchmark", "item_id"), StoreSpec("labels", "doc_id"), StoreSpec("conversations", ("conv_id", "turn")),
    )
}
PLAIN_PART = StoreSpec("part", "p_partkey")
PRIORITIES = ["1-URGENT", "2-HIGH"]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return add


def matches(name: str, table: str, filter_: Any, columns: list[str], where: str, spec: StoreSpec | None = None) -> None:
    """Registers a query for all records of a table that match a filter."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.matching(read(spark, sf_dir, table), spec or SPECS[table], {"filter": filter_}).select(*columns)

    QUERIES[name] = run
    SQL[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {where}"


# --- filters -----------------------------------------------------------------------------------------------------------

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount"]
matches("id_lookup", "part", {"_id": "42"}, ["p_partkey", "p_name"], "p_partkey = 42")
matches("multi_id", "part", {"_id": {"in": ["1", "5", "9", "x"]}}, ["p_partkey", "p_name"], "p_partkey IN (1, 5, 9)")
matches("id_alias", "part", {"id": ["2", "7"]}, ["p_partkey"], "p_partkey IN (2, 7)")
matches("exact_string", "customer", {"c_mktsegment": "BUILDING"}, ["c_custkey", "c_mktsegment"], "c_mktsegment = 'BUILDING'")
matches("exact_number", "part", {"p_size": 10}, ["p_partkey", "p_size"], "p_size = 10")
matches("exact_other_family", "part", {"p_name": 5}, ["p_partkey"], "false")
matches("list_as_in", "orders", {"o_orderpriority": PRIORITIES}, ["o_orderkey", "o_orderpriority"], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
for _name, _op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    matches(f"cmp_{_name}", "lineitem", {"l_quantity": {_name: 25}}, LINE, f"l_quantity {_op} 25")
matches("range_closed", "lineitem", {"l_quantity": {">=": 10, "<": 20}}, LINE, "l_quantity >= 10 AND l_quantity < 20")
matches("range_time", "orders", {"o_orderdate": {"gte": "1995-01-01", "lt": "1996-01-01"}}, ["o_orderkey", "o_totalprice"], "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
matches("op_eq", "lineitem", {"l_returnflag": {"eq": "R"}}, LINE, "l_returnflag = 'R'")
matches("op_neq", "lineitem", {"l_returnflag": {"neq": "R"}}, LINE, "l_returnflag IS DISTINCT FROM 'R'")
matches("op_in", "orders", {"o_orderpriority": {"is_included": PRIORITIES}}, ["o_orderkey"], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
matches("op_nin", "orders", {"o_orderpriority": {"not_included": PRIORITIES}}, ["o_orderkey"], "NOT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)")
matches("contains_substring", "part", {"p_name": {"contains": "RED"}}, ["p_partkey", "p_name"], "contains(lower(p_name), 'red')", PLAIN_PART)
matches("unknown_operator", "part", {"p_size": {"near": 3, "lte": 2}}, ["p_partkey"], "p_size <= 2")
matches("null_shorthand", "part", {"p_size": None}, ["p_partkey"], "false")
matches("text_exact", "part", {"p_name": "red widget"}, ["p_partkey", "p_name"], "p_name = 'red widget'")
matches("logic_and", "orders", {"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"gt": 200000}}]}, ["o_orderkey"], "o_orderstatus = 'F' AND o_totalprice > 200000")
matches("logic_or", "orders", {"$or": [{"o_orderstatus": "P"}, {"o_totalprice": {"lt": 20000}}]}, ["o_orderkey"], "o_orderstatus = 'P' OR o_totalprice < 20000")
matches(
    "logic_nested", "lineitem", {"$or": [{"$and": [{"l_returnflag": "A"}, {"$or": [{"l_quantity": {"lt": 5}}, {"l_quantity": {"gt": 45}}]}]}, {"l_discount": {"gte": 0.09}}]}, LINE,
    "(l_returnflag = 'A' AND (l_quantity < 5 OR l_quantity > 45)) OR l_discount >= 0.09",
)
matches(
    "compound", "lineitem", {"l_linestatus": "O", "l_quantity": {"gte": 10, "lte": 30}, "$or": [{"l_returnflag": {"in": ["A", "R"]}}, {"l_tax": {"eq": 0.02}}]}, LINE,
    "l_linestatus = 'O' AND l_quantity BETWEEN 10 AND 30 AND (l_returnflag IN ('A', 'R') OR l_tax = 0.02)",
)
matches("empty_filter", "region", {}, ["r_regionkey", "r_name"], "true")
matches("or_empty", "region", {"$or": []}, ["r_regionkey", "r_name"], "false")
matches("list_filter", "orders", [{"o_orderstatus": "O"}, {"o_orderpriority": "5-LOW"}], ["o_orderkey"], "o_orderstatus = 'O' AND o_orderpriority = '5-LOW'")
matches("nested_path", "events", {"k": {"gte": 50}}, ["event_id"], "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
matches("doc_exists", "events", {"k": {"exists": True}, "other": {"exists": False}}, ["event_id"], "json_extract(props, '$.k') IS NOT NULL")
matches("array_exists", "embeddings", {"embedding": {"exists": True}, "label": {"lt": 5}}, ["vec_id", "label"], "len(embedding) > 0 AND label < 5")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none, which makes nulls."""
    labels = read(spark, sf_dir, "labels")
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")


def label_matches(name: str, filter_: dict, where: str) -> None:
    spec = StoreSpec("labelled", "doc_id")
    QUERIES[name] = lambda spark, sf_dir: search.matching(labelled(spark, sf_dir), spec, {"filter": filter_}).select("doc_id", "quality")
    SQL[name] = f"SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE {where}"


label_matches("neq_null", {"quality": {"neq": 1}}, "quality IS DISTINCT FROM 1")
label_matches("eq_null", {"quality": {"eq": None}}, "quality IS NULL")
label_matches("neq_is_null", {"quality": {"neq": None}}, "quality IS NOT NULL")
label_matches("nin_null", {"quality": {"nin": [1]}}, "NOT coalesce(quality IN (1), false)")
label_matches("in_null", {"quality": {"in": [None, 0]}}, "quality = 0 OR quality IS NULL")
label_matches("nin_with_null", {"quality": {"nin": [None, 0]}}, "quality IS NOT NULL AND quality <> 0")
label_matches("exists_true", {"quality": {"exists": True}}, "quality IS NOT NULL")
label_matches("exists_false", {"quality": {"exists": False}}, "quality IS NULL")
label_matches("or_nulls", {"$or": [{"quality": {"gt": 0}}, {"lang": "en"}]}, "quality > 0 OR lang = 'en'")



def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which every seventh has no date."""
    return read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("dated"))


_DATED = "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS dated FROM orders) WHERE "


def time_matches(name: str, filter_: dict, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: search.matching(dated(spark, sf_dir), StoreSpec("dated", "o_orderkey"), {"filter": {"dated": filter_}}).select("o_orderkey")
    SQL[name] = _DATED + where


_DAYS = "TIMESTAMP '1996-01-02', TIMESTAMP '1995-03-04'"
time_matches("time_neq_unparsed", {"neq": "garbage"}, "true")
time_matches("time_neq", {"neq": "1996-01-02"}, "dated IS DISTINCT FROM TIMESTAMP '1996-01-02'")
time_matches("time_nin_unparsed", {"nin": ["garbage"]}, "true")
time_matches("time_nin", {"nin": ["garbage", "1996-01-02", "1995-03-04"]}, f"NOT coalesce(dated IN ({_DAYS}), false)")
time_matches("time_nin_null", {"nin": [None, "garbage", "1996-01-02"]}, "dated IS NOT NULL AND dated <> TIMESTAMP '1996-01-02'")
time_matches("time_in", {"in": ["garbage", "1996-01-02", "1995-03-04"]}, f"dated IN ({_DAYS})")

# --- text --------------------------------------------------------------------------------------------------------------

_SIGNS = EDGE_SIGNS.replace("'", "''")
_STOPS = ", ".join(f"'{word}'" for word in STOP_WORDS)


def tok(text: str) -> str:
    """The tokens of a text in SQL."""
    return f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{SPACE_CLASS}'), lambda w: trim(w, '{_SIGNS}')), lambda w: length(w) > 1 AND w NOT IN ({_STOPS}))"


def token_matches(name: str, value: Any, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: search.matching(read(spark, sf_dir, "documents"), SPECS["documents"], {"filter": {"text": value}}).select("doc_id", "n_chars")
    SQL[name] = f"WITH t AS (SELECT doc_id, n_chars, {tok('text')} AS tok FROM documents) SELECT doc_id, n_chars FROM t WHERE {where}"


token_matches("contains_tokens", {"contains": "From, er the"}, "list_contains(tok, 'from') AND list_contains(tok, 'er')")
token_matches("contains_no_tokens", {"contains": "the a"}, "false")
token_matches("keywords_and", ["from", "er"], "list_contains(tok, 'from') AND list_contains(tok, 'er')")
token_matches("keyword_multi_token", ["from er", "th"], "(list_contains(tok, 'from') OR list_contains(tok, 'er')) AND list_contains(tok, 'th')")
token_matches("keywords_empty", [], "false")


_indexes: dict[tuple[str, str], str] = {}


def indexed_documents(spark: SparkSession, sf_dir: str) -> StoreSpec:
    """The documents with a table of token postings, written once for an application and folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = f"{scratch(spark)}/postings-{uuid.uuid4().hex}"
        index.write_index(_postings(spark, sf_dir), path)
        _indexes[key] = path
    return SPECS["documents"].changed(indexes={"text": _indexes[key]})


def indexed_matches(name: str, value: Any, like: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: search.matching(read(spark, sf_dir, "documents"), indexed_documents(spark, sf_dir), {"filter": {"text": value}}).select("doc_id", "n_chars")
    SQL[name] = SQL[like]


indexed_matches("indexed_contains", {"contains": "From, er the"}, "contains_tokens")
indexed_matches("indexed_keywords", ["from er", "th"], "keyword_multi_token")


@query(f"WITH t AS (SELECT doc_id, n_chars, {tok('text')} AS tok FROM documents) SELECT doc_id, n_chars FROM t WHERE (list_contains(tok, 'from') AND list_contains(tok, 'er')) OR n_chars < 200")
def indexed_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in the index beside another test."""
    filter_ = {"$or": [{"text": {"contains": "from er"}}, {"n_chars": {"lt": 200}}]}
    return search.matching(read(spark, sf_dir, "documents"), indexed_documents(spark, sf_dir), {"filter": filter_}).select("doc_id", "n_chars")


@query(f"SELECT doc_id, len({tok('text')})::BIGINT AS n_tokens FROM documents")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return index.postings(docs, record_id(SPECS["documents"], docs), F.col("text"))


_POSTED = f"p AS (SELECT DISTINCT unnest({tok('text')}) AS token, CAST(doc_id AS VARCHAR) AS _id FROM documents)"


@query(f"WITH {_POSTED} SELECT token, _id FROM p")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir)


@query(f"WITH {_POSTED} SELECT token, count(*) AS n_records FROM p GROUP BY token")
def posting_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.posting_sizes(_postings(spark, sf_dir))


@query(f"WITH {_POSTED} SELECT _id FROM p GROUP BY _id HAVING bool_or(token IN ('from', 'er')) AND bool_or(token = 'th')")
def search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search_postings(_postings(spark, sf_dir), ["from er", "th"])


@query(f"WITH {_POSTED} SELECT DISTINCT _id FROM p WHERE token IN ('from', 'er', 'th')")
def keywords_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.search_postings(_postings(spark, sf_dir), ["from er", "th"], mode="or")


@query("SELECT CAST(p_size AS DOUBLE) AS value, count(*) AS n_records, min(CAST(p_partkey AS VARCHAR)) AS first_id, max(CAST(p_partkey AS VARCHAR)) AS last_id FROM part GROUP BY 1")
def numeric_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return index.numeric_index(part, record_id(SPECS["part"], part), F.col("p_size"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS field FROM events")
def discover_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.discover_fields(read(spark, sf_dir, "events"), "props")


@query("SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS field")
def discover_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.discover_fields(read(spark, sf_dir, "customer"))


# --- order, pages, records -----------------------------------------------------------------------------------------------


def pages_of(name: str, table: str, q: Q, columns: list[str], tail: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: search.page(read(spark, sf_dir, table), SPECS[table], q).select(*columns)
    SQL[name] = f"SELECT {', '.join(columns)} FROM {table} {tail}"


FLAGSHIP = (Q.field("o_totalprice").gte(100000) & Q.field("o_totalprice").lt(300000) & Q.field("o_orderstatus").eq("F")).sort("-o_totalprice").limit(20)
ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice"]
pages_of("flagship_page", "orders", FLAGSHIP, ORDER, "WHERE o_totalprice >= 100000 AND o_totalprice < 300000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
pages_of("sort_asc_page", "orders", Q().sort("+o_totalprice").limit(20).offset(40), ORDER, "ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 20 OFFSET 40")
pages_of("sort_desc_page", "orders", Q().sort("-o_totalprice").limit(20).offset(40), ORDER, "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
pages_of("default_limit", "orders", Q().sort("o_orderdate"), ORDER, "ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 300")
pages_of("unsorted_page", "orders", Q.field("o_orderstatus").eq("P").limit(15), ORDER, "WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 15")
pages_of("limit_zero", "orders", Q().limit(0), ORDER, "LIMIT 0")
pages_of("hydrate_page", "customer", Q.field("c_mktsegment").eq("MACHINERY").sort("-c_acctbal").limit(25), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "WHERE c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 25")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS FIRST, doc_id LIMIT 50")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(labelled(spark, sf_dir), StoreSpec("labelled", "doc_id"), Q().sort("+quality").limit(50)).select("doc_id", "quality")


@query("SELECT count(*) AS total_matches FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20")
def total_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.matching(read(spark, sf_dir, "lineitem"), SPECS["lineitem"], {"filter": {"l_quantity": {">=": 10, "<": 20}}})
    return found.agg(F.count(F.lit(1)).alias("total_matches"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 17, 99)")
def multi_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.multi_read(read(spark, sf_dir, "customer"), SPECS["customer"], ["3", "17", "99", "none"]).select("c_custkey", "c_name")


@query("SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def hydrate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = search.matching(read(spark, sf_dir, "orders"), SPECS["orders"], {"o_orderstatus": "P"}).select(F.col("o_custkey").cast("string").alias("_id"))
    return search.hydrate(read(spark, sf_dir, "customer"), SPECS["customer"], ids).select("_id", "c_name", "c_acctbal")


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS record_count FROM {name}" for name in sorted(SPECS)))
def list_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.record_counts({name: read(spark, sf_dir, name) for name in SPECS})


# --- folds of a log: events as operations on users -----------------------------------------------------------------------


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: ``_id`` is the user, an error deletes, anything else writes its value under its type."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").cast("string").alias("_id"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"),
        F.when(F.col("event_type") != "error", F.to_json(F.create_map("event_type", F.round(F.col("value") * 100).cast("long")))).alias("delta"),
    )


@query("SELECT user_id, arg_max(value, row(ts, event_id)) AS value, arg_max(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id")
def fold_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.latest(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", "event_type")


@query(
    "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id) SELECT user_id, value FROM l WHERE event_type <> 'error'"
)
def fold_with_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = fold.latest(read(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "value")
    return last.where("event_type <> 'error'").select("user_id", "value")


@query("SELECT user_id, event_type, arg_max(value, row(ts, event_id)) AS value FROM events GROUP BY ALL")
def fold_columnwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


_FOLDED = """
    WITH dead AS (SELECT user_id, max(event_id) AS deleted FROM events WHERE event_type = 'error' GROUP BY user_id),
    live AS (SELECT e.user_id, event_type, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS v FROM events e LEFT JOIN dead d ON e.user_id = d.user_id
             WHERE event_type <> 'error' AND (deleted IS NULL OR event_id > deleted) GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS _id, '{' || string_agg('"' || event_type || '":' || v, ',' ORDER BY event_type) || '}' AS doc FROM live GROUP BY user_id"""


@query(_FOLDED)
def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_shallow(events_log(spark, sf_dir))


@query(_FOLDED)
def fold_deep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_deep(events_log(spark, sf_dir))


@query(_FOLDED)
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold_shallow(fold.compacted(events_log(spark, sf_dir)))


@query("""
    WITH a AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
         b AS (SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS old, b.v AS new, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.v IS DISTINCT FROM b.v""")
def diff_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    before = fold.latest(events.where("ts < timestamp_ntz'2024-01-15'"), "user_id", ["event_id"], "value")
    after = fold.latest(events.where("ts >= timestamp_ntz'2024-01-05'"), "user_id", ["event_id"], "value")
    return fold.diff(before, after, ["user_id"], "value")


@query("""
    WITH e AS (SELECT event_id // 1000 AS segment, user_id, event_id, length(props)::BIGINT AS size, event_id = max(event_id) OVER (PARTITION BY user_id) AS live FROM events),
         s AS (SELECT segment, sum(size)::BIGINT AS physical, coalesce(sum(size) FILTER (live), 0)::BIGINT AS logical FROM e GROUP BY 1)
    SELECT segment, physical, logical, round((physical - logical) / physical, 6) AS dead, (physical - logical) / physical > 0.3 AND logical > 0 AS compact FROM s""")
def segment_dead_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.dead_ratio(_entries(spark, sf_dir))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 1000).cast("long").alias("segment"), F.col("user_id").cast("string").alias("_id"), F.col("event_id").alias("seq"), F.length("props").cast("long").alias("size")
    )


@query("WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS _id FROM l WHERE last // 1000 = (SELECT max(event_id) // 1000 FROM events)")
def segment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    return fold.segment_members(entries, entries.agg(F.max("segment")).first()[0])


@query("""
    WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT CAST(user_id AS VARCHAR) AS _id, min(ts) AS began, max(ts) AS ended, count(*) AS n_writes, min(event_id) AS first_seq, max(event_id) AS last_seq FROM s GROUP BY user_id, n""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.debounced(events_log(spark, sf_dir), 6 * 3600)


@query("SELECT event_id, event_type || '.k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def flatten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("_id"), F.concat(F.lit('{"'), "event_type", F.lit('":'), "props", F.lit("}")).alias("doc"))
    return fold.flat_paths(docs).select(F.col("_id").cast("long").alias("event_id"), "path", "value")


@query("""
    WITH l AS (SELECT user_id, event_type, arg_max(CAST(round(value * 100) AS BIGINT), event_id) AS v FROM events GROUP BY ALL)
    SELECT CAST(user_id AS VARCHAR) AS _id, '{"last":{' || string_agg('"' || event_type || '":{"v":' || v || '}', ',' ORDER BY event_type) || '}}' AS doc FROM l GROUP BY user_id""")
def fold_deep_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects three deep, written one path at a time, both as objects and as dotted paths; a shallow fold would lose all paths but the last."""
    value = F.round(F.col("value") * 100).cast("long")
    nested = F.to_json(F.create_map(F.lit("last"), F.create_map("event_type", F.create_map(F.lit("v"), value))))
    dotted = F.to_json(F.create_map(F.concat(F.lit("last."), "event_type", F.lit(".v")), value))
    ops = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("_id"), F.lit("write").alias("op"), F.when(F.col("event_id") % 2 == 0, nested).otherwise(dotted).alias("delta"))
    return fold.fold_deep(ops)


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def nest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names become structs, and structs dotted names again."""
    flat = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("who.name"), F.col("c_nationkey").alias("who.home.nation"), F.col("c_acctbal").alias("balance"))
    nested = flat.select(*fold.nest_columns(flat.columns))
    again = nested.select(*fold.flatten_columns(nested.schema))
    return again.select(F.col("key").alias("c_custkey"), F.col("`who.name`").alias("c_name"), F.col("`who.home.nation`").alias("c_nationkey"), F.col("balance").alias("c_acctbal"))


# --- logs as text, audits, single reads ----------------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS _id, '{\"name\":\"' || c_name || '\"}' AS doc FROM customer")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as text lines, ``id {json}``, and read again."""
    path = f"{scratch(spark)}/segments-{uuid.uuid4().hex}"
    segments.write_segments(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.to_json(F.struct(F.col("c_name").alias("name"))).alias("doc")), path, 1000)
    return segments.read_segments(spark, path).select("_id", "doc")


@query("SELECT CAST(user_id AS VARCHAR) AS _id, '{\"n\":' || max(event_id) || '}' AS doc FROM events GROUP BY user_id")
def segment_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each record over a log of several segments."""
    path = f"{scratch(spark)}/segments-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    segments.write_segments(events.select(F.col("user_id").cast("string").alias("_id"), F.to_json(F.struct(F.col("event_id").alias("n"))).alias("doc")), path, 1000)
    return segments.current_versions(segments.read_segments(spark, path))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25")
def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark)}/log-{uuid.uuid4().hex}"
    read(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return segments.read_json_log(spark, path, "event_id long, event_type string", 25, "event_id")


@query("SELECT 'changed' AS state, 1 AS n UNION ALL SELECT 'missing', 1")
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a table against a manifest: one was rewritten since, one is gone."""
    path = f"{scratch(spark)}/audited-{uuid.uuid4().hex}"
    read(spark, sf_dir, "nation").repartition(4).write.parquet(path)
    now = audit.manifest(spark, path, "*.parquet")
    first = now.agg(F.min("path")).scalar()
    before = now.withColumn("sha256", F.when(F.col("path") == first, "other").otherwise(F.col("sha256"))).union(spark.range(1).select(F.lit("gone").alias("path"), F.lit(1).cast("long"), F.lit("x")))
    return audit.damaged(before, now).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT '3' AS _id, count(*) > 0 AS found FROM customer WHERE c_custkey = 3 UNION ALL SELECT 'none', false")
def record_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read(spark, sf_dir, "customer")
    return fold.union_all([spark.range(1).select(F.lit(id_).alias("_id"), F.lit(search.exists(customer, SPECS["customer"], id_)).alias("found")) for id_ in ("3", "none")])


@query("SELECT DISTINCT unnest(json_keys(props)) AS field FROM events EXCEPT SELECT 'other'")
def new_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.new_fields(read(spark, sf_dir, "events"), spark.range(1).select(F.lit("other").alias("field")), "props")


@query("SELECT 'fresh' AS stores, 'ok' AS state UNION ALL SELECT 'growing', 'low' UNION ALL SELECT 'long', 'degraded'")
def id_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh, growing, long = (StoreSpec("s", "k", identity=x) for x in (Identity(), Identity(length=30, auto_expand=True), Identity(length=40)))
    groups = {"fresh": [fresh], "growing": [fresh, growing], "long": [fresh, growing, long]}
    return fold.union_all([spark.range(1).select(F.lit(name).alias("stores"), F.lit(metrics.health(specs)).alias("state")) for name, specs in groups.items()])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 1")
def custom_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.matching(read(spark, sf_dir, "orders"), SPECS["orders"], {"filter": {"o_orderstatus": "F"}}, F.col("o_orderkey") % 3 == 1).select("o_orderkey")


@query("SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50")
def nested_path_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("props", F.concat(F.lit('{"a":{"b":'), "props", F.lit("}}")))
    return search.matching(events, SPECS["events"], {"filter": {"a.b.k": {"gte": 50}}}).select("event_id")


# --- figures of a request log: events as requests ------------------------------------------------------------------------

_LOG = """
    WITH log AS (SELECT event_id, ts, 'store' || (user_id % 5) AS store, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'query' WHEN 'signup' THEN 'delete' WHEN 'purchase' THEN 'write' ELSE 'error' END AS op,
                        'user' || user_id AS client, CASE WHEN event_id % 3 = 0 THEN 'socket' ELSE 'http' END AS transport, length(props)::BIGINT AS bytes_in, event_id % 1000 AS bytes_out, value AS duration_ms FROM events)"""
_COUNTS = "count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'write') AS writes, count(*) FILTER (op = 'delete') AS deletes, count(*) FILTER (op = 'query') AS queries, count(*) FILTER (op = 'error') AS errors, count(*) FILTER (op = 'rate_limited') AS rate_limited, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out"


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    op = F.when(kind == "view", "read").when(kind == "click", "query").when(kind == "signup", "delete").when(kind == "purchase", "write").otherwise("error")
    return read(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat(F.lit("store"), F.col("user_id") % 5).alias("store"), op.alias("op"), F.concat(F.lit("user"), "user_id").alias("client"),
        F.when(F.col("event_id") % 3 == 0, "socket").otherwise("http").alias("transport"), F.length("props").cast("long").alias("bytes_in"), (F.col("event_id") % 1000).alias("bytes_out"),
        F.col("value").alias("duration_ms"),
    )


@query(f"{_LOG} SELECT store, {_COUNTS} FROM log GROUP BY store")
def metrics_by_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_store(request_log(spark, sf_dir))


@query(f"{_LOG} SELECT store, transport, {_COUNTS} FROM log GROUP BY ALL")
def metrics_by_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_transport(request_log(spark, sf_dir))


@query(f"{_LOG} SELECT store, client, {_COUNTS} FROM log GROUP BY ALL")
def metrics_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_client(request_log(spark, sf_dir))


@query(
    f"{_LOG} SELECT store, transport, client, CASE WHEN grouping(transport) = 0 THEN 'transport' WHEN grouping(client) = 0 THEN 'client' ELSE 'store' END AS level, {_COUNTS} "
    "FROM log GROUP BY GROUPING SETS ((store), (store, transport), (store, client))"
)
def metrics_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.breakdown(request_log(spark, sf_dir))


@query(f"{_LOG} SELECT store, {_COUNTS} FROM log GROUP BY ROLLUP (store)")
def metrics_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(request_log(spark, sf_dir))


@query(f"{_LOG}, c AS (SELECT store, client, {_COUNTS} FROM log GROUP BY ALL) SELECT *, reads + writes + queries AS activity FROM c ORDER BY activity DESC, store, client LIMIT 10")
def top_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_clients(request_log(spark, sf_dir))


@query(f"{_LOG}, s AS (SELECT 'store' || r_regionkey AS store FROM region UNION ALL SELECT 'idle'), c AS (SELECT store, {_COUNTS} FROM log GROUP BY store) SELECT store, "
       + ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*metrics.COUNTERS.values(), "bytes_in", "bytes_out"]) + " FROM s LEFT JOIN c USING (store)")
def metrics_all_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "region").select(F.concat(F.lit("store"), "r_regionkey").alias("name")).union(spark.range(1).select(F.lit("idle").alias("name")))
    return metrics.all_stores(names, request_log(spark, sf_dir))


@query(f"{_LOG} SELECT store, client AS ip, count(*) AS n FROM log WHERE op = 'error' GROUP BY ALL")
def limited_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir)
    return metrics.limited_clients(log.withColumn("op", F.when(F.col("op") == "error", "rate_limited").otherwise(F.col("op"))))


@query(f"{_LOG} SELECT event_id, store, op FROM log WHERE op = 'error' ORDER BY ts DESC, event_id DESC LIMIT 40")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).withColumn("level", F.col("op"))
    return recent.latest_events(log, 40, "error", ("ts", "event_id")).select("event_id", "store", "op")


@query(f"{_LOG}, r AS (SELECT event_id, store, row_number() OVER (PARTITION BY store ORDER BY ts DESC, event_id DESC)::INT AS rank FROM log WHERE op = 'error') SELECT * FROM r WHERE rank <= 50")
def latest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.latest_per_key(request_log(spark, sf_dir).where("op = 'error'").select("event_id", "store", "ts"), ["store"], ["ts", "event_id"]).select("event_id", "store", "rank")


@query(f"{_LOG}, r AS (SELECT event_id, store, duration_ms, row_number() OVER (PARTITION BY store ORDER BY ts DESC, event_id DESC)::INT AS rank FROM log WHERE duration_ms >= 400) SELECT * FROM r WHERE rank <= 50")
def slow_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = request_log(spark, sf_dir).select("event_id", "store", "ts", "duration_ms")
    return recent.slow_queries(log, 400, ["store"], ["ts", "event_id"]).select("event_id", "store", "duration_ms", "rank")


_WINDOW = "count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, {_WINDOW} AS in_window FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.rate_window(read(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 3600).select("event_id", "in_window")


@query(f"WITH w AS (SELECT event_id, {_WINDOW.replace('user_id ORDER', 'user_id, event_type ORDER')} AS in_window FROM events) SELECT * FROM w WHERE in_window > 1")
def rate_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return recent.blocked(requests, ["user_id", "event_type"], "ts", 1, 3600).select("event_id", "in_window")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def ttl_unexpired(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return recent.unexpired(events, "ts", events.agg(F.max("ts")).scalar(), 86400).select("event_id")


@query("WITH u AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS _id FROM u ORDER BY t DESC, _id DESC OFFSET 10")
def evicted_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.evicted(read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "ts"), "user", "ts", 10).select("_id")


@query("WITH u AS (SELECT user_id, max(ts) AS t, count(*) AS n FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS _id FROM u ORDER BY n DESC, t DESC, _id DESC OFFSET 10")
def evicted_lfu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent.evicted(read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "ts"), "user", "ts", 10, "lfu").select("_id")


@query("""
    WITH g AS (SELECT user_id, event_type, max(value) > 450 AS can_read FROM events GROUP BY ALL)
    SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id AND g.event_type = e.event_type AND can_read)""")
def permitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    grants = events.groupBy("user_id", "event_type").agg((F.max("value") > 450).alias("can_read"))
    return access.permitted(events, grants, "can_read", "user_id", "event_type").select("event_id")


@query("SELECT count(*) AS n, count(*) AS n_ids, 16 AS shortest, 16 AS longest FROM customer")
def generate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    live = customers.select(F.col("c_custkey").cast("string").alias("_id"))
    drawn = access.with_new_ids(customers.select("c_name"), Identity(), live, 5)
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_id").alias("n_ids"), F.min(F.length("_id")).alias("shortest"), F.max(F.length("_id")).alias("longest"))


# --- streams ---------------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.files_as_stream(spark, f"{sf_dir}/events.parquet*", read(spark, sf_dir, "events").schema)  # a stream reads a folder or a pattern, and the table may be one file


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/stream-{uuid.uuid4().hex}"


@query(SQL["fold_latest"].replace(", arg_max(event_type, row(ts, event_id)) AS event_type", ""))
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, folded batch by batch; the result is what the batch fold gives."""
    folder = _folder(spark)
    feed.log_latest(_stream(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["value"], folder, f"{folder}/checkpoint").awaitTermination()
    kept = feed.read_batches(spark, folder, "latest", "user_id long, ts timestamp_ntz, event_id long, value double")
    return fold.latest(kept, "user_id", ["ts", "event_id"], "value")


@query("SELECT 'update' AS type, 'users' AS store, CAST(user_id AS VARCHAR) AS record_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op FROM events")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation reaches the subscriber, by way of a stream."""
    folder = _folder(spark)
    ops = _stream(spark, sf_dir).select(F.lit("users").alias("store"), F.col("user_id").cast("string").alias("_id"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"))
    feed.subscribe(ops, "users", lambda changes, n: changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}"), f"{folder}/checkpoint", once=True).awaitTermination()
    return feed.read_batches(spark, folder, "changes", "type string, store string, record_id string, op string")


@query(SQL["fold_documents"])
def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations logged by a stream, with dead letters split off, and folded."""
    folder = _folder(spark)
    kind, value = F.col("event_type"), F.round(F.col("value") * 100).cast("long")
    ops = _stream(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("_id"), F.when(kind == "error", "delete").otherwise("write").alias("op"), F.when(kind != "error", F.to_json(F.create_map(kind, value))).alias("delta")
    )
    feed.log_operations(ops, folder, f"{folder}/checkpoint").awaitTermination()
    return fold.fold_shallow(feed.read_batches(spark, folder, "ops", fold.OPS))


@query("SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS _id, CASE WHEN event_type = 'click' THEN 'rename' ELSE 'write' END AS op, CASE WHEN event_type = 'view' THEN '[1]' ELSE '{}' END AS delta FROM events WHERE event_type IN ('error', 'click', 'view')")
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations without an id, of an unknown kind, or that write no object, as a stream splits them off."""
    folder = _folder(spark)
    kind = F.col("event_type")
    ops = _stream(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.when(kind != "error", F.col("user_id").cast("string")).alias("_id"), F.when(kind == "click", "rename").otherwise("write").alias("op"), F.when(kind == "view", "[1]").otherwise("{}").alias("delta")
    )
    feed.log_operations(ops, folder, f"{folder}/checkpoint").awaitTermination()
    return feed.read_batches(spark, folder, "dead_letters", fold.OPS)
