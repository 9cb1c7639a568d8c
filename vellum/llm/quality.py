"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader steps.

A text becomes words (letters and digits) and runs of other signs; its features are the single tokens and the pairs of
neighbours, hashed to 2^18 places, with the square root of the relative frequency as value. A pair of equal tokens is
one shared feature, since repetition is what such a pair says. A score is the sigmoid of one sparse dot product.

Training reads a bounded sample of labelled rows (``MAX_TRAINING_ROWS``, taken by a hash of the id) in one task; the
model is 1 MB whatever the corpus, and it is all that is broadcast. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import bound_batches, text_or_empty, texts_of
from vellum.llm.shingles import mix, word_hashes

#: Labelled rows that training reads at most (in expectation of the hash sample), the documented bound of the model fit.
MAX_TRAINING_ROWS = 8000
BITS = 18
EPOCHS = 3
#: Step size, its smoothing, and the two penalties of the follow-the-regularised-leader update.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.01

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
_SAME = np.uint64(0x5BD1E9955BD1E995)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text; both are empty for a text without tokens."""
    h = word_hashes(_TOKEN.findall(text.encode("utf-8", "surrogatepass").lower()))
    if not len(h):
        return np.empty(0, np.int64), np.empty(0)
    pairs = np.where(h[:-1] == h[1:], _SAME, mix(h[:-1] * _ODD + h[1:]))
    places = (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)
    places, counts = np.unique(places, return_counts=True)
    return places, np.sqrt(counts / counts.sum())


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights of the places and, last, the bias. ``rows`` are changed: each gets the bias as its last feature."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)
    bias_at, bias_value = np.array([2**BITS]), np.array([1.0])

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for k, (at, x) in enumerate(rows):  # in place, as the rows are most of a worker's memory
        rows[k] = (np.concatenate([at, bias_at]), np.concatenate([x, bias_value]))
    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, labels, strict=True):
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    return weights(z, n).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> np.ndarray:
    """Weights learnt from the rows of ``docs`` whose id has a label and is not held out.

    Rows with a null id or label are left out; of several labels of one id the smallest counts. Without any labelled row
    the weights are zero and each score is 0.5.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).where(~held_out("doc_id"))
    count = known.count()
    share = min(1.0, MAX_TRAINING_ROWS / max(count, 1))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2**30)) < int(share * 2**30)).limit(MAX_TRAINING_ROWS * 5 // 4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, target = [], []
        for batch in batches:
            found += [features(text) for text in texts_of(batch.column("text"))]
            target += batch.column("label").to_pylist()
        model = train(found, target).tobytes()
        found.clear()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    ordered = rows.select("doc_id", "text", "label").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text")
    models = ordered.select("text", "label").mapInArrow(run, "model binary").collect()
    return np.frombuffer(models[0][0], np.float32) if models else np.zeros(2**BITS + 1, np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of ids that training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def with_scores(docs: DataFrame, weights: np.ndarray, score_col: str) -> DataFrame:
    """All columns of ``docs`` and, last, the score (0 to 1) of the whole text as ``score_col``; a null text scores as an empty one, by the bias alone."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(np.float64)
        for batch in batches:
            sums = np.empty(batch.num_rows)
            for k, text in enumerate(texts_of(batch.column(batch.num_columns - 1))):
                at, x = features(text)
                sums[k] = w[at] @ x + w[-1]
            scores = pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], score_col])

    shape = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.select("*", text_or_empty().alias(score_col)).mapInArrow(score, shape)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Defined cases: null and empty texts get the score of the bias; a null id is not held out; rows that repeat an id are
    scored one by one; an empty table gives an empty result; columns other than doc_id and text are never read.
    """
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.5; columns stay.

    Defined cases: null and empty texts are judged by the bias; each row is judged by its own text, whatever its id; an
    empty table gives an empty result; the column of the score takes a name that no column has.
    """
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_scores(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).drop(name)
