"""Substring dedup: runs of consecutive sentences that the corpus has seen before are removed.

A sentence ends after ``. ! ? ,`` or a line feed and the white space behind it; one of more than ``WORDS`` words is cut
into pieces before words that a hash of the word chooses, so that equal passages inside sentences are cut alike. From every
piece on, and up to every piece, the shortest run of at least ``RUN`` pieces with at least ``WORDS`` words is hashed (128
bits, letters A to Z in lower case, white space as one space). Any longer run is the union of such runs, so these find what
all runs would. The smallest doc_id that holds a run keeps it, and there the first place; pieces that any other occurrence
covers are removed.

A document sends each of its runs once; the shuffle folds them to a count and a smallest id on the map side, so a passage
in a third of all documents costs one row a task. The join back carries 28 bytes of each run that a bit map of fixed size
does not rule out; adaptive execution splits it where a run is frequent. Positions of a document meet again by its id, bounded by its own length.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bit_map, bits_of, bound_batches, slices_of, text_or_empty, written
from vellum.llm.shingles import mix

#: Consecutive sentences (or pieces of long ones), and words, that a run has at least.
RUN, WORDS = 2, 20
#: One word in so many begins a piece of a long sentence, and the most words of such a piece.
ONE_IN, PIECE_WORDS = 4, 10
#: Bits of the map that tells which runs may be repeated; a set bit is confirmed by a join.
MAP_BITS = 26
#: Odd multipliers of the two halves of a run's hash, and their inverses modulo 2^64.
_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_BASE, _INVERSE = np.array(_ODD, np.uint64), np.array([pow(x, -1, 2**64) for x in _ODD], np.uint64)
_SENTENCE = re.compile(r"[^.!?,\n]*(?:[.!?,\n]+[ \t\n\x0b\x0c\r]*|\Z)")
_WORD = re.compile(r"[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+(?:[ \t\n\x0b\x0c\r]+\Z)?")


def sentences(text: str) -> list[str]:
    """Pieces that join to the text; those of white space alone go with the sentence before."""
    out: list[str] = []
    for piece in _SENTENCE.findall(text):
        if out and not piece.strip(" \t\n\x0b\x0c\r"):
            out[-1] += piece
        elif piece:
            out.append(piece)
    return out


def split_long(sentence: str) -> list[str]:
    """The pieces of a sentence; one of at most ``WORDS`` words is one piece."""
    plain = sentence.encode("utf-8", "surrogatepass").lower().split() if len(sentence) > 2 * WORDS else []
    if len(plain) <= WORDS:
        return [sentence]
    starts = [0]
    for k, code in enumerate(map(zlib.crc32, plain)):
        if code % ONE_IN == 0 and k:
            starts.extend(range(starts[-1] + PIECE_WORDS, k, PIECE_WORDS))
            starts.append(k)
    starts.extend(range(starts[-1] + PIECE_WORDS, len(plain), PIECE_WORDS))
    words = _WORD.findall(sentence)
    return ["".join(words[start:end]) for start, end in itertools.pairwise([*starts, len(words)])]


def pieces_of(text: str) -> tuple[list[str], list[int]]:
    """Pieces that join to the text, and the sentence of each."""
    pieces: list[str] = []
    owners: list[int] = []
    for k, sentence in enumerate(sentences(text)):
        if len(sentence) <= 2 * WORDS:
            pieces.append(sentence)
            owners.append(k)
        else:
            part = split_long(sentence)
            pieces += part
            owners += [k] * len(part)
    return pieces, owners


def _normal(pieces: list[str]) -> list[bytes]:
    """The pieces in lower case, with one space between words and none around them."""
    text = "\0".join(pieces)
    if text.count("\0") >= len(pieces):  # a piece holds the mark itself
        return [b" ".join(piece.encode("utf-8", "surrogatepass").lower().split()) for piece in pieces]
    spaced = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    return spaced.replace(b" \0", b"\0").replace(b"\0 ", b"\0").split(b"\0") if pieces else []


class Runs(NamedTuple):
    """The shortest run from each piece and up to each piece that has one, of many documents, in order; equal passages have equal hashes."""

    begin: np.ndarray  #: number of the first piece of each document, and of all pieces
    owner: np.ndarray  #: place of a run's document
    place: np.ndarray  #: number of the run in its document
    start: np.ndarray  #: first piece, counted over all documents
    end: np.ndarray  #: piece after the last
    halves: np.ndarray  #: 128-bit hash, as two numbers
    first: np.ndarray  #: the first run of the document with the same hash


def runs_of(documents: list[list[str]]) -> Runs:
    normal = [_normal(pieces) for pieces in documents]
    flat = [piece for pieces in normal for piece in pieces]
    n = len(flat)
    begin = np.cumsum([0, *map(len, normal)])
    last = np.repeat(begin[1:], np.diff(begin))  # the piece after the last of the document, by piece
    words = np.cumsum([0, *(piece.count(b" ") + 1 if piece else 0 for piece in flat)])
    ends = np.maximum(np.searchsorted(words, words[:-1] + WORDS), np.arange(n) + RUN)
    starts = np.flatnonzero(ends <= last)
    ends = ends[starts]
    # where a run from some piece ends, the last such run is also the shortest up to there
    held = np.zeros(n + 1, bool)
    held[ends] = True
    least = np.full(n, n + 1)  # the first end of a run in the document, by its last piece
    np.minimum.at(least, last[starts] - 1, ends)
    rest = np.arange(1, n + 1)
    rest = rest[(rest > least[last - 1]) & ~held[1:]]
    more = np.minimum(np.searchsorted(words, words[rest] - WORDS, "right") - 1, rest - RUN)
    spans = np.sort(np.concatenate([starts * (n + 1) + ends, more * (n + 1) + rest]))
    starts, ends = spans // (n + 1), spans % (n + 1)
    owner = np.searchsorted(begin, starts, "right") - 1
    place = np.arange(len(starts)) - np.searchsorted(owner, owner)
    # sums of the hashes of pieces times powers of odd numbers; equal runs differ by the power of their start, which is taken out
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat)), np.uint64).reshape(-1, 2)
    powers = np.multiply.accumulate(np.vstack([np.ones((1, 2), np.uint64), np.broadcast_to(_BASE, (n, 2))]), axis=0)
    inverse = np.multiply.accumulate(np.vstack([np.ones((1, 2), np.uint64), np.broadcast_to(_INVERSE, (n, 2))]), axis=0)
    sums = np.vstack([np.zeros((1, 2), np.uint64), np.cumsum(hashes * powers[:n], axis=0, dtype=np.uint64)])
    halves = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)[:, None]).view(np.int64)
    order = np.lexsort((halves[:, 1], halves[:, 0], owner))  # stable: of equal runs the first comes first
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (halves[order][1:] != halves[order][:-1]).any(axis=1)
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1]
    return Runs(begin, owner, place, starts, ends, halves, first)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices_of(batches):
        found = runs_of([pieces_of(text)[0] for text in part.column("text").to_pylist()])
        own = found.first == np.arange(len(found.first))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(found.owner[own])), pa.array(found.place[own].astype(np.int32)), *(pa.array(found.halves[own, k]) for k in range(2))], names=["doc_id", "place", "h1", "h2"]
        )


def seen_before(docs: DataFrame) -> DataFrame:
    """(doc_id, places): numbers of a document's runs that a smaller doc_id holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(F.col("doc_id").isNotNull())
    found = rows.mapInArrow(_emit, "doc_id long, place int, h1 long, h2 long")
    repeated = written(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).drop("last"))
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(repeated, F.col("h1").bitwiseAND(F.lit(2**MAP_BITS - 1)), MAP_BITS))

    def emit_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words64 = bits.value
        for batch in _emit(batches):
            yield batch.filter(pa.array(bits_of(words64, batch.column("h1").to_numpy() & (2**MAP_BITS - 1))))

    found = rows.mapInArrow(emit_repeated, "doc_id long, place int, h1 long, h2 long")
    return found.join(repeated, ["h1", "h2"]).where(F.col("doc_id") > F.col("first")).groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def covered(found: Runs, places: list[list[int] | None]) -> np.ndarray:
    """Which pieces a repeated run covers: runs of the numbers ``places`` of each document, and repeats within a text."""
    n = np.bincount(found.owner, minlength=len(places))
    since = np.cumsum(n) - n
    gone = found.first != np.arange(len(found.first))
    # later places of a run that another document holds go with its first place here
    back = np.zeros(len(gone), bool)
    back[found.first[np.array([since[row] + k for row, some in enumerate(places) for k in some or () if k < n[row]], np.int64)]] = True
    gone |= back[found.first]
    change = np.zeros(found.begin[-1] + 1, np.int64)
    np.add.at(change, found.start[gone], 1)
    np.add.at(change, found.end[gone], -1)
    return np.cumsum(change)[:-1] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (without repeated pieces), n_sentences, n_removed (sentences of which nothing is left), removed_chars for each row of ``docs``.

    Defined cases: a null text is empty; texts shorter than a run stay whole, whatever they repeat; a row with a null id
    loses only repeats within itself; rows that repeat an id count as one document and keep what it holds; an empty table
    gives an empty result; other columns are ignored.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            out, texts = [], batch.column("text").to_pylist()
            cut = [pieces_of(text) for text in texts]
            found = runs_of([pieces for pieces, _ in cut])
            covers = covered(found, batch.column("places").to_pylist())
            for text, (pieces, owners), start, end in zip(texts, cut, found.begin[:-1], found.begin[1:], strict=True):
                gone = covers[start:end].tolist()
                n = owners[-1] + 1 if owners else 0
                if True not in gone:
                    out.append((text, n, 0, 0))
                    continue
                kept = "".join(p for p, g in zip(pieces, gone, strict=True) if not g)
                left = {k for k, g in zip(owners, gone, strict=True) if not g}
                out.append((kept, n, n - len(left), len(text) - len(kept)))
            texts, n, removed, chars = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(chars, pa.int64())],
                names=["doc_id", "text", "n_sentences", "n_removed", "removed_chars"],
            )

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.join(seen_before(docs), "doc_id", "left").select("doc_id", "text", "places").mapInArrow(clean, "doc_id long, text string, n_sentences long, n_removed long, removed_chars long")
