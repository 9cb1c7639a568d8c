"""Queries of the text operators against SQL where it can say them, and the pipeline stage by stage against brute force."""

import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_exact, brute_near
from tests.llm.test_text import check_packing
from tests.oracle import DATA, connection, spark_rows, sql_rows
from vellum.llm import quality, secret_scan
from vellum.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(connection(), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, DATA).select("doc_id").collect()} == ids


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id: r.predicted for r in quality.score_documents(docs, labels).collect()}
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    want = {d for d in rows if kept[d]}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.asDict() for r in docs.collect()}
        words = secret_scan.learn_dictionary(docs) if name == "secrets" else b""
        path = str(tmp_path / f"{k}-{name}")
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "exact_dedup":
            want = {d for d, keep, *_ in brute_exact([(d, x["text"]) for d, x in before.items()]) if d == keep}
        if name == "near_dedup":
            want = {d for d, (_, first) in brute_near([(d, x["text"]) for d, x in before.items()], 80).items() if d == first}
        if name == "packing":
            check_packing([(d, x["text"]) for d, x in before.items()], docs.collect())
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.asDict() for r in docs.collect()}
        if name == "secrets":
            assert after.keys() == before.keys()
            for d, x in before.items():
                text = secret_scan.redact(x["text"], secret_scan.scan(x["text"], words))
                assert after[d]["text"] == text and after[d]["n_chars"] == (x["n_chars"] if text == x["text"] else len(text))
        else:
            assert set(after) == want and all(after[d] == before[d] for d in after)
    assert docs.count() == corpus_pipeline.run(spark, DATA).count()
