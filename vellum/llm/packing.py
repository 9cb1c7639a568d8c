"""Packing by lexical retrieval: a sharded BM25 index gives each seed document neighbours that fill its window.

1. Every document is tokenised once; the ids (two or four bytes each) go to the shared checkpoint folder together with
   the number of documents that hold each id, a sum for each task. Spark adds these up over all documents; they give the idf.
2. Documents meet in shards by content alone: they are range partitioned and sorted by a path of content keys, the least
   hashes of their distinct ids in some orders, the least hash of their token shingles, and the hash of all ids. So documents
   that share rare keys are neighbours. A task cuts its sorted run into shards of ``SHARD_TOKENS`` tokens, from
   three quarters of that on where the coarse keys change. Equal texts have equal keys and stay together, unless the copies
   of one text overfill a shard: these are spread by row.
3. Inside a shard an inverted index (ids to documents with BM25 weights) ranks the unused documents for each seed. The
   seed opens a window, neighbours fill it in order, and the document that overruns the window is cut; its rest seeds the
   next one. The last window of a shard is cut into sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import batches_of, bound_batches, cut_lineage, text_or_empty, written
from vellum.llm.shingles import mix

WINDOW = 4096
END_ID = 2
#: Tokens of a shard; a task holds the ids and the index of one shard at a time.
SHARD_TOKENS = 2**19
#: Words that a worker's memo of encoded words holds at most before it starts anew.
MEMO_WORDS = 500_000
#: Content keys of a document: least hashes of its ids in so many orders, then of its shingles, then the hash of all ids.
ORDERS, SHINGLE = 4, 5
PATH = ORDERS + 2
_KEYS = [f"key{k}" for k in range(PATH)]
#: Shards that a task numbers at most; its partition stands above them.
SHARDS_OF_TASK = 2**13
K1, B = 1.2, 0.75
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = _ODD ** np.arange(1, 2 * ORDERS, 2, dtype=np.uint64)
#: Signs that end a word of letters (ASCII, or Latin-1 in UTF-8): the vocabulary splits them off, so they may as well stand
#: alone. An apostrophe may not, as it belongs to what follows.
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~](?:(?<=[a-z].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))[!-&(-/:-@\[-`{-~]*(?=[ \n])")

#: How the files are built whose words can be encoded one by one. White space only separates words, and case is dropped.
_BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "</w>",
)

_tokenizers: dict = {}


def _splits_at_spaces(path: str) -> bool:
    """Whether the file is of the kind of ``_BY_WORDS`` and its special tokens hold ``<|`` and no white space."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [token["content"] for token in spec["added_tokens"]]
    return (spec["normalizer"], spec["pre_tokenizer"], spec["model"].get("end_of_word_suffix")) == _BY_WORDS and all("<|" in x and not re.search(r"\s", x) for x in special)


def _tokenizer(path: str) -> tuple:
    """The tokenizer of a file, the same for words of letters (None where words cannot stand alone), which ids end a word, and the memo of words; one set a worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        letters = None
        if _splits_at_spaces(path):
            letters = Tokenizer(tokenizer.model)
            letters.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[i for piece, i in tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        _tokenizers[path] = (tokenizer, letters, ends, {})
    return _tokenizers[path]


def _encode_words(tokenizer, letters, ends: np.ndarray, new: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(word, ids) of words. Nothing splits a word of letters, so it needs no patterns; such words end where a piece with a word end does, so many are encoded as one text."""
    plain, other = [], []
    for word in new:
        text = word.decode("utf-8", "replace")
        (plain if text.isalpha() and text.lower().isalpha() else other).append((word, text))
    for part in batches_of(plain, 4096):
        ids = np.array(letters.encode_batch_fast([" ".join(text for _, text in part)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(part):
            other += part
            continue
        cells, stops = ids.tobytes(), (stops * 4).tolist()
        yield from zip((word for word, _ in part), (cells[a:b] for a, b in zip([0, *stops], stops)), strict=True)
    for part in batches_of(other, 4096):
        coded = tokenizer.encode_batch_fast([text for _, text in part], add_special_tokens=False)
        yield from ((word, np.array(x.ids, np.uint32).tobytes()) for (word, _), x in zip(part, coded, strict=True))


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text, and ``END_ID`` after them.

    Where the vocabulary drops white space and case, a text encodes as its runs without ASCII white space do, one after
    another, in lower case; a run that the worker has met before is looked up. Texts with ``<|`` keep their case, and their
    runs stay whole, as special tokens are spelled so. A tokenizer of another kind gets whole texts.
    """
    tokenizer, letters, ends, memo = _tokenizer(path)
    if letters is None:
        return [np.array([*x.ids, END_ID], np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    if len(memo) > MEMO_WORDS:
        memo.clear()
    bodies = (text.encode("utf-8", "surrogatepass") for text in texts)
    split = [body.split() if b"<|" in body else _TAIL.sub(rb" \g<0>", body.lower()).split() for body in bodies]
    memo.update(_encode_words(tokenizer, letters, ends, set().union(*split).difference(memo)))
    last = END_ID.to_bytes(4, "little")
    return [np.frombuffer(b"".join([*map(memo.__getitem__, found), last]), np.uint32) for found in split]


def _distinct(documents: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, count) of the distinct ids of each document, sorted; ids are under ``size``."""
    flat = np.concatenate(documents)
    owner = np.repeat(np.arange(len(documents)), [len(x) for x in documents])
    codes = owner * size + flat
    codes, counts = np.unique(codes.astype(np.uint32) if len(documents) * size < 2**32 else codes, return_counts=True)
    owner, ids = np.divmod(codes.astype(np.int64), size)
    return owner, ids, counts


def _paths(documents: list[np.ndarray], owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ``PATH`` content keys of each document, coarse to fine; ``owner`` and ``ids`` are its distinct ids. Equal documents have equal keys."""
    out = np.empty((len(documents), PATH), np.uint64)
    starts = np.searchsorted(owner, np.arange(len(documents)))
    for k, odd in enumerate(_ORDERS):
        out[:, k] = np.minimum.reduceat(mix((ids.astype(np.uint64) + np.uint64(1)) * odd), starts)
    flat = np.concatenate(documents).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum([len(x) for x in documents])
    rolled = flat.copy()
    for k in range(1, SHINGLE):
        rolled[:-k] = rolled[:-k] * _ODD + flat[k:]
    rolled = mix(rolled)
    for k in range(1, SHINGLE):  # shingles that begin too near the end of a document reach into the next
        rolled[np.maximum(ends - k, 0)] = np.iinfo(np.uint64).max
    out[:, -2] = np.minimum.reduceat(rolled, np.concatenate([[0], ends[:-1]]))
    out[:, :-1] = mix(out[:, :-1])  # long documents have small least hashes; in the order of the keys they are no neighbours
    out[:, -1] = [xxhash.xxh3_64_intdigest(x) for x in documents]
    return out.view(np.int64)


def _tokenise(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n, key0 to key5 (content keys) of each row, and rows with ``term`` and ``df`` alone: document counts of ids, summed over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(_tokenizer(path)[2])
        df = np.zeros(size, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n", pa.int64()), *((key, pa.int64()) for key in _KEYS), ("term", pa.int64()), ("df", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = encode(part.column("text").to_pylist(), path)
                owner, ids, _ = _distinct(coded, size)
                df += np.bincount(ids, minlength=size)
                narrow = [(b"2" + x.astype(np.uint16).tobytes()) if x.max() < 65536 else (b"4" + x.tobytes()) for x in coded]
                none, paths = pa.nulls(len(coded), pa.int64()), _paths(coded, owner, ids)
                keys = [pa.array(paths[:, k].copy()) for k in range(PATH)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(narrow, pa.binary()), pa.array([len(x) for x in coded], pa.int64()), *keys, none, none], schema=schema)
        there = np.flatnonzero(df)
        nulls = [pa.nulls(len(there), field.type) for field in list(schema)[:-2]]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(there), pa.array(df[there])], schema=schema)

    return docs.mapInArrow(run, f"doc_id long, ids binary, n long, {', '.join(f'{key} long' for key in _KEYS)}, term long, df long")


def _ids(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint16 if cell[:1] == b"2" else np.uint32, offset=1).astype(np.uint32)


def _document_counts(coded: DataFrame) -> np.ndarray:
    """In how many documents each id occurs; at most as long as the vocabulary."""
    sums = coded.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    terms = sums.column("term").to_numpy()
    out = np.zeros(terms.max(initial=0) + 1, np.int64)
    out[terms] = sums.column("df").to_numpy()
    return out


def _in_order(coded: DataFrame, n_tokens: int) -> DataFrame:
    """doc_id, ids, n and keys of each document, range partitioned and sorted by content keys; copies that overfill a shard are spread by row."""
    rows = coded.where("term IS NULL").drop("term", "df")
    overfull = rows.groupBy(_KEYS[-1]).agg(F.sum("n").alias("tokens")).where(F.col("tokens") > SHARD_TOKENS).select(_KEYS[-1], F.lit(True).alias("spread"))
    # written, so that Spark knows how few these are and need not shuffle the rows; of many it would
    salted = rows.join(written(overfull), _KEYS[-1], "left").withColumn("salt", F.when(F.col("spread"), F.col("row")).otherwise(0)).drop("spread")
    parts = max(1, min(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // SHARD_TOKENS)))
    order = [*_KEYS, "salt"]
    return salted.repartitionByRange(parts, *order).sortWithinPartitions(*order, "doc_id", "row").select("doc_id", "ids", "n", *_KEYS)


def shards_of(rows: Iterator[tuple], limit: int) -> Iterator[list[tuple]]:
    """Sorted ``rows`` (coarse key, key of the text, n, ...) in runs of ``limit`` tokens: a run ends before it would pass that, unless equal texts go on, which
    end it behind that, and from three quarters of it on where the coarse keys change."""
    held: list[tuple] = []
    tokens = 0
    for row in rows:
        coarse, text, n = row[:3]
        if held:
            last = held[-1]
            full = tokens >= limit if text == last[1] else tokens + n > limit
            if full or (tokens * 4 >= limit * 3 and coarse != last[0]):
                yield held
                held, tokens = [], 0
        held.append(row)
        tokens += n
    if held:
        yield held


class Index:
    """Inverted index of one shard: postings of each term, with BM25 weights."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        owner, flat, tf = _distinct(documents, len(idf))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(documents)))])
        norm = K1 * (1 - B + B * np.array([len(x) for x in documents])[owner] / mean)
        weights = idf[flat] * tf * (K1 + 1) / (tf + norm)
        there = np.bincount(flat, minlength=len(idf)) > 0
        self.terms = (np.cumsum(there) - 1)[flat]
        lengths = np.bincount(self.terms)
        self.n = len(documents)
        # terms of more than an eighth of the documents are rows of a matrix (of at most eight cells a posting), others lists
        common = lengths * 8 > self.n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.dense = np.zeros((int(common.sum()), self.n), np.float32)
        dense = common[self.terms]
        self.dense[self.row[self.terms[dense]], owner[dense]] = weights[dense]
        listed = np.flatnonzero(~dense)
        listed = listed[np.argsort(self.terms[listed], kind="stable")]
        self.docs, self.weights = owner[listed], weights[listed]
        self.lengths = np.where(common, 0, lengths)
        self.ends = np.cumsum(self.lengths)

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct terms of ``seed``."""
        query = self.terms[self.starts[seed] : self.starts[seed + 1]]
        rows = self.row[query]
        length = self.lengths[query]
        at = np.repeat(self.ends[query] - np.cumsum(length), length) + np.arange(length.sum())
        return np.bincount(self.docs[at], self.weights[at], minlength=self.n) + self.dense[rows[rows >= 0]].sum(axis=0)


def chain(index: Index, sizes: np.ndarray) -> list[int]:
    """The order in which documents of a shard fill its windows."""
    unused = np.ones(index.n, bool)
    order, room, at = [], 0, 0
    seed = -1
    while len(order) < index.n:
        if room == 0 or seed < 0:
            if seed < 0:
                while not unused[at]:
                    at += 1
                seed = at
                unused[seed] = False
                order.append(seed)
                room = -int(sizes[seed]) % WINDOW
                continue
        scores = index.scores(seed)
        scores[~unused] = -1
        ranked = np.argsort(-scores, kind="stable")
        seed = -1
        for best in ranked[: np.count_nonzero(unused)]:
            if scores[best] <= 0:
                break
            unused[best] = False
            order.append(int(best))
            if sizes[best] >= room:
                if sizes[best] > room:
                    seed, room = int(best), -int(sizes[best] - room) % WINDOW
                break
            room -= int(sizes[best])
        else:
            break
    return order


def cut(order: list[int], documents: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece."""
    total = sum(len(x) for x in documents)
    bounds = [WINDOW] * (total // WINDOW) + [2**k for k in reversed(range(WINDOW.bit_length() - 1)) if total % WINDOW & 2**k]
    sequence = offset = 0
    for document in order:
        start = 0
        while start < len(documents[document]):
            length = min(len(documents[document]) - start, bounds[sequence] - offset)
            yield document, start, length, sequence, offset
            start, offset = start + length, offset + length
            if offset == bounds[sequence]:
                sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of all rows of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Defined cases: a null or empty text is the single id 2; a row with a null id is packed under a null doc_id; rows that
    repeat an id are packed one by one; texts longer than a window fill several; an empty table gives no pieces; other
    columns are ignored. Documents without a common scored term follow in the order of their content keys.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    coded = cut_lineage(_tokenise(rows, tokenizer_path).withColumn("row", F.monotonically_increasing_id()))
    counts = _document_counts(coded)
    n_docs, n_tokens = coded.where("term IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    mean = max(n_tokens, 1) / max(n_docs, 1)
    idf = coded.sparkSession.sparkContext.broadcast(np.log1p((n_docs - counts + 0.5) / (counts + 0.5)).astype(np.float32))

    limit = SHARD_TOKENS

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * SHARDS_OF_TASK

        def rows() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(c).to_numpy().view(np.uint64) for c in _KEYS]
                coarse = functools.reduce(lambda a, b: mix(a + b * _ODD), columns[:ORDERS])
                yield from zip(coarse.tolist(), columns[-1].tolist(), *(batch.column(c).to_pylist() for c in ("n", "ids", "doc_id")), strict=True)

        for shard, held in enumerate(shards_of(rows(), limit)):
            if shard == SHARDS_OF_TASK:
                raise RuntimeError("a task has more shards than it can number; use more shuffle partitions")
            documents = [_ids(cell) for *_, cell, _ in held]
            sizes = np.array([len(x) for x in documents])
            pieces = list(cut(chain(Index(documents, idf.value, mean), sizes), documents))
            who, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(documents[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
            ids = pa.array([doc_id for *_, doc_id in held], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(who)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[who]), pa.array(sequence + ((first + shard) << 32)), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return _in_order(coded, n_tokens).mapInArrow(fill, schema)
