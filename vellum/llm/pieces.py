"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text has an edge for each piece of the vocabulary that matches there. A forward Viterbi pass gives the
best score from the start to each position, which is the exact rest cost of a search backwards from the end: A* pops whole
segmentations in order of score and touches nothing that is not on one of the N best. A character that no piece covers is
one edge of byte pieces with the penalty of an unknown character.

A segmentation's score is the sum over its pieces, so scores must be log probabilities. A file of merges has ranks instead
(0, -1, -2, ...), whose sum says little. They are read as frequency ranks: p is in proportion to 1 / (``RANK_OFFSET`` +
rank), the law of Zipf and Mandelbrot. Nothing is trained.

No piece of the vocabulary has a space mark after another character (checked on load), so a text's lattice is a chain of
independent lattices, cut before each run of space marks. Words repeat, so a worker keeps what it knows of the words it
has met in a memo of bounded size; a text's own N best are the best sums over its words.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bound_batches, text_or_empty

SPACE = "▁"
#: Segmentations of a text that are sought.
N_BEST = 3
#: What an unknown character scores below the lowest piece, as the library has it.
UNKNOWN_PENALTY = 10.0
#: Where scores are ranks: what is added to a rank before its reciprocal is a frequency.
RANK_OFFSET = 100
#: Scores at or under this mark pieces for runs of spaces; they don't set the scale of unknown characters.
_NEVER = -1e8
#: Words and characters that a worker's memo holds at most before it starts anew, and texts that are encoded together.
MEMO_WORDS, MEMO_CHARS, TEXTS = 1_000_000, 16_000_000, 256
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _log_probabilities(scores: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """(id, score) with log probabilities where the scores are ranks; others stay, as do those of pieces that are never used.

    They are multiples of 2^-20, so sums are exact in any order.
    """
    used = [s for _, s in scores if s > _NEVER]
    if len(set(used)) < len(used) or any(s > 0 or s != int(s) for s in used):
        return scores
    total = math.log(sum(1 / (RANK_OFFSET - s) for s in used)) if used else 0.0
    return [(i, s if s <= _NEVER else round((-math.log(RANK_OFFSET - s) - total) * 2**20) / 2**20) for i, s in scores]


class Model:
    """Pieces and scores of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(len(model))
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if i not in special and not model.is_byte(i)}
        self.pieces = dict(zip(self.pieces, _log_probabilities(list(self.pieces.values())), strict=True))
        if any(SPACE in piece.lstrip(SPACE) for piece in self.pieces):
            raise ValueError("a piece has a space mark after another character")
        self.single = {piece for piece in self.pieces if len(piece) == 1}
        self.unknown = min((s for _, s in self.pieces.values() if s > _NEVER), default=0.0) - UNKNOWN_PENALTY
        self.texts = {i: piece.replace(SPACE, " ").encode("utf-8", "surrogatepass") for piece, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.matcher = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.matcher.add_word(piece, (len(piece), -score, (i,)))
        self.matcher.make_automaton()

    def lattice(self, text: str) -> tuple[list[list[tuple]], list[float], list]:
        """Edges (length, cost, ids) into each position, least cost from the start to it, and the edge on the least way.

        A cost is a score with its sign turned.
        """
        size = len(text)
        into: list[list[tuple]] = [[] for _ in range(size + 1)]
        ahead, way = [0.0] + [np.inf] * size, [None] * (size + 1)
        if self.single.issuperset(text):
            for last, edge in self.matcher.iter(text):  # matches come by their ends, so the way to their starts is known
                end = last + 1
                into[end].append(edge)
                cost = ahead[end - edge[0]] + edge[1]
                if cost < ahead[end]:
                    ahead[end], way[end] = cost, edge
            return into, ahead, way
        for at, char in enumerate(text):
            if char not in self.single:
                into[at + 1].append((1, -self.unknown, tuple(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))))
        for last, edge in self.matcher.iter(text):
            into[last + 1].append(edge)
        for end in range(1, size + 1):
            for edge in into[end]:
                cost = ahead[end - edge[0]] + edge[1]
                if cost < ahead[end]:
                    ahead[end], way[end] = cost, edge
        return into, ahead, way

    def search(self, text: str, n: int) -> tuple[list, list[tuple[float, int, tuple | None]]]:
        """The edges of least ways, and the ``n`` best segmentations, best first, as (cost, position, edges behind it).

        Each open end of the backward search stands for segmentations of its own, the best of which costs what the end
        promises. So a popped end is a segmentation: the least way leads on from its position, the other edges met there
        open new ends, and no more ends are kept than segmentations are still wanted.
        """
        into, ahead, way = self.lattice(text)
        agenda: list[tuple] = [(ahead[-1], 0, len(text), 0.0, None)]
        out: list[tuple[float, int, tuple | None]] = []
        ticket = 0
        while agenda:
            cost, _, end, behind, path = agenda.pop(0)
            out.append((cost, end, path))
            wanted = n - len(out)
            if not wanted:
                break
            bound = agenda[-1][0] if len(agenda) == wanted else np.inf
            while end:
                best = way[end]
                for edge in into[end]:
                    if edge is not best:
                        start, so_far = end - edge[0], behind + edge[1]
                        promise = so_far + ahead[start]
                        if promise < bound:
                            ticket += 1
                            insort(agenda, (promise, ticket, start, so_far, (edge[2], path)))
                            if len(agenda) >= wanted:
                                del agenda[wanted:]
                                bound = agenda[-1][0]
                path = (best[2], path)
                behind += best[1]
                end -= best[0]
        return way, out

    @staticmethod
    def ids_of(way: list, end: int, path: tuple | None) -> list[int]:
        """The ids of a segmentation that :meth:`search` found."""
        while end:
            path = (way[end][2], path)
            end -= way[end][0]
        ids: list[int] = []
        while path:
            ids += path[0]
            path = path[1]
        return ids

    def n_best(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The ``n`` best (score, ids) of a text with space marks, best first; fewer if it has fewer segmentations."""
        way, found = self.search(text, n)
        return [(-cost, self.ids_of(way, end, path)) for cost, end, path in found]


class Memo:
    """What is known of words: best ids, their number, best score, losses of the next best, and whether they decode to the word."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.sizes, self.scores, self.losses, self.same = array("q"), array("d"), array("d"), array("b")
        self.chars = 0

    def add(self, word: str) -> None:
        """``word`` stands for itself after one space mark."""
        model = self.model
        chunk = SPACE + word
        way, found = model.search(chunk, N_BEST)
        least, end, path = found[0]
        ids = model.ids_of(way, end, path)
        self.at[word] = len(self.ids)
        self.ids.append(array("I", ids).tobytes())
        self.sizes.append(len(ids))
        self.scores.append(-least)
        self.losses.extend([cost - least for cost, _, _ in found[1:]] + [np.inf] * (N_BEST - len(found)))
        self.same.append(b"".join([model.texts[i] for i in ids]) == chunk.replace(SPACE, " ").encode("utf-8", "surrogatepass"))
        self.chars += len(word)

    def encode(self, texts: list[str]) -> list[tuple[bytes, int, list[float], bool]]:
        """(ids of the best segmentation, their number, scores of the N best, whether they decode to the text) of each text."""
        if len(self.ids) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.clear()
        split = [words_of(text) for text in texts]
        for word in set().union(*split):
            if word not in self.at:
                self.add(word)
        if not self.ids:
            self.add("")  # so that there is something to look up for texts without words
        sizes, scores, same = np.frombuffer(self.sizes, np.int64), np.frombuffer(self.scores), np.frombuffer(self.same, bool)
        losses = np.frombuffer(self.losses).reshape(-1, N_BEST - 1)
        out = []
        for words in split:
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            best = float(scores[at].sum())
            near = losses[at].ravel()
            first = np.argpartition(near, N_BEST - 2)[: N_BEST - 1] if len(near) > N_BEST - 1 else np.arange(len(near))
            singles = sorted((float(near[k]), int(k) // (N_BEST - 1)) for k in first if near[k] < np.inf)
            ids = b"".join([self.ids[k] for k in at.tolist()])
            out.append((ids, int(sizes[at].sum()), [best, *(best - loss for loss in _least_sums(singles, N_BEST - 1))], bool(same[at].all())))
        return out


def words_of(text: str) -> list[str]:
    """Pieces of a text between single spaces; more spaces, and literal space marks, stand as space marks before the next piece."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and not text.endswith(" "):
        return text.split(" ")
    return [chunk[1:] for chunk in _CHUNK.findall(mark(text))]


def _least_sums(singles: list[tuple[float, int]], n: int) -> list[float]:
    """The ``n`` least sums over sets of single (loss, word), at most one for each word."""
    sums = [(0.0, frozenset())]
    for loss, at in singles:
        sums += [(total + loss, used | {at}) for total, used in sums if at not in used]
    return sorted(total for total, used in sums if used)[:n]


def mark(text: str) -> str:
    """A text as the lattice sees it: a space mark before it and for each space; nothing for nothing."""
    return SPACE + text.replace(" ", SPACE) if text else ""


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=2)
def memo_of(path: str) -> Memo:
    return Memo(model_of(path))


def decode(ids: list[int], path: str) -> str:
    """The text of ids; bytes that are not UTF-8 become replacement characters, space marks become spaces."""
    return b"".join(model_of(path).texts.get(i, b"") for i in ids).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, scores (of the N best, best first), round_trip for each row; ``ids`` too if asked for.

    round_trip: the decoded best ids give back the text (a literal space mark comes back as a space). Defined cases: a null
    text is empty; an empty text has no pieces and the one score 0; words of any length are fine; null and repeated ids pass
    through row by row; an empty table gives an empty result; other columns are not read. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = memo_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids, n, scores, same = zip(*memo.encode(part.column("text").to_pylist()), strict=True)
                out = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(same, pa.bool_())]
                if with_ids:
                    out.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_pieces", "ids_crc32", "scores", "round_trip", "ids"][: len(out)])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, round_trip boolean" + ", ids array<int>" * with_ids)
