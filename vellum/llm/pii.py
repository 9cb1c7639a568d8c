"""Personal data: fixed patterns, and terms that give a protected entity away.

Protected entities are what the patterns find, at three levels: the value itself, its group (domain of an address, network
of an ip, issuer of a card, area of a phone number) and its kind; a value that is seen once is judged by its group and kind.
The corpus is asked which words stand near an entity. Over documents, p(t), p(c) and p(t, c) of a word t and an entity c
(t within ``NEAR_WORDS`` words of c) give the point-wise mutual information log(p(t, c) / p(t) p(c)), and its share of the
information content of c, -log p(c), says how much of the entity the word discloses. A word that reaches ``DISCLOSURE`` with
at least ``SUPPORT`` different surroundings (copies of a passage are one) is a span wherever it stands, near the entity or
in documents without it. In sanitised text an entity is generalised to its kind and a disclosing word is removed.

The first pass over the texts finds entities; rows, texts and all, go to the shared folder, so that later passes know the
rows again. Documents with entities emit their (entity, word) pairs, which are counted by document with map-side sums. A word is in
no fewer documents than it is near some entity in; where that alone keeps a pair under the threshold, it is dropped. A pass
over all texts counts the words of the other supported pairs, and a last one looks disclosing words up; for both a bit map of
fixed size keeps other words out of the shuffle, and an exact join decides.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bit_map, bits_of, bound_batches, text_or_empty, texts_of, written
from vellum.llm.shingles import word_hashes

KINDS = ("email", "ip", "card", "phone", "term")
#: Words before and after an entity that count as near it.
NEAR_WORDS = 32
#: Different surroundings that a pair needs, and the share of the entity's information from which a word discloses it.
SUPPORT, DISCLOSURE = 3, 0.9
BITMAP_BITS = 22
#: Stands among the words of an entity for the entity itself, and among entities for any of them.
_ITSELF = _ANY = 0
_PAIRS = 100_000
#: Different terms that a task counts before it hands the counts on.
_TERMS = 500_000

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
#: Letters and digits, whole characters outside ASCII but general and CJK punctuation; three bytes at least.
_WORD = re.compile(rb"(?=[A-Za-z0-9\x80-\xff]{3})(?:[A-Za-z0-9]++|(?!\xe2\x80|\xe3\x80)[\xc2-\xf4][\x80-\xbf]++)++")
_NO_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)


def _luhn(digits: bytes) -> bool:
    total = sum((d - 48) if k % 2 == 0 else (d - 48) * 2 - 9 * (d > 52) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(body: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns, by start, then kind."""
    found = []
    floor, at = 0, body.find(b"@")
    while at >= 0:
        before = body[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(body, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
        floor = domain.end() if domain else at + 1
        at = body.find(b"@", floor)
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(body) if all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in m[0].split(b"."))]
    for m in _CARD.finditer(body):
        digits = m[0].translate(None, _NO_DIGIT)
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if b"+" in body:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(body) if 9 <= len(m[0].translate(None, _NO_DIGIT)) <= 15]
    return sorted(found)


def levels(kind: int, value: bytes) -> tuple[bytes, ...]:
    """Names of an entity: the value, its group and its kind."""
    low = value.lower()
    digits = low.translate(None, _NO_DIGIT)
    group = (low[low.index(b"@") :] if kind == 0 else b".".join(low.split(b".")[:3]) if kind == 1 else digits[:6]) if kind < 3 else digits[:-4]
    return b"%d:%s" % (kind, low), b"%d:group:%s" % (kind, group), b"%d" % kind


def _signed(value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(value) - 2**63


def _terms(body: bytes) -> list[tuple[int, int]]:
    """(start, end) in bytes of the words of a text; numbers are none."""
    return [m.span() for m in _WORD.finditer(body) if not m[0].isdigit()]


def _inside(spans: list[tuple[int, int, int]], words: list[tuple[int, int]]) -> list[bool]:
    """Which words touch one of ``spans``, sorted by start."""
    out, at, reach = [], 0, 0
    for start, end in words:
        while at < len(spans) and spans[at][0] < end:
            reach = max(reach, spans[at][2])
            at += 1
        out.append(reach > start)
    return out


def near_words(body: bytes, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(entity, term, surrounding) of each entity of a text with itself and with the words near it, and of any entity with each such word once; hashes are signed 64-bit."""
    words = _terms(body)
    words = [w for w, hit in zip(words, _inside(spans, words), strict=True) if not hit]
    starts = [s for s, _ in words]
    lower = body.lower()
    hashes = [_signed(lower[s:e]) for s, e in words]
    met: set[int] = set()
    for start, kind, end in spans:
        at = bisect_left(starts, start)
        low, high = max(0, at - NEAR_WORDS), at + NEAR_WORDS
        around = _signed(b"".join(lower[s:e] + b" " for s, e in words[low:high]))
        for entity in map(_signed, levels(kind, body[start:end])):
            for term in {_ITSELF, *hashes[low:high]}:
                yield entity, term, around
        met.update(hashes[low:high])
    yield from ((_ANY, term, 0) for term in met)


def _points(body: bytes, text: str, places: list[int]) -> dict[int, int]:
    """Code points before each byte place; places are borders of characters."""
    if len(body) == len(text):
        return {p: p for p in places}
    out, at, seen = {}, 0, 0
    for p in sorted(set(places)):
        seen += len(body[at:p].decode("utf-8", "surrogatepass"))
        at, out[p] = p, seen
    return out


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, spelled = ([], [], [], []), [], []
        for text in texts_of(batch.column("text")):
            body = text.encode("utf-8", "surrogatepass")
            spans = base_spans(body)
            at = _points(body, text, [x for s, _, e in spans for x in (s, e)])
            for kind, column in enumerate(counts):
                column.append(sum(x[1] == kind for x in spans))
            spelled.append(",".join(f"{KINDS[k]}:{at[s]}:{at[e]}" for s, k, e in spans))
            digests.append(hashlib.sha256(spelled[-1].encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spelled, pa.string())],
            names=[*batch.schema.names, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base"],
        )


_FOUND = "doc_id long, text string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string"


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "entity", "term", "around"]

    def out(held: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=names)

    held: list[tuple[int, int, int, int]] = []
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), texts_of(batch.column("text")), strict=True):
            body = text.encode("utf-8", "surrogatepass")
            for pair in near_words(body, base_spans(body)):
                held.append((row, *pair))
                if len(held) == _PAIRS:
                    yield out(held)
                    held = []
    if held:
        yield out(held)


def _summed(counts: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, n) of a task, each term once; where more than ``_TERMS`` differ, what is summed up so far goes first."""
    terms, n = np.empty(0, np.int64), np.empty(0, np.int64)
    for more, times in counts:
        both = np.union1d(terms, more)
        summed = np.zeros(len(both), np.int64)
        summed[np.searchsorted(both, terms)] += n
        summed[np.searchsorted(both, more)] += times
        terms, n = both, summed
        if len(terms) > _TERMS:
            yield terms, n
            terms, n = terms[:0], n[:0]
    yield terms, n


def disclosing(found: DataFrame) -> DataFrame:
    """(term): words over the thresholds for some entity of ``found`` (row, text, base).

    Of a pair the documents that hold it are counted, of a word and of an entity the documents that hold them.
    """
    met = found.where("base <> ''").select("row", "text").mapInArrow(_pair_rows, "row long, entity long, term long, around long")
    by_row = met.groupBy("entity", "term", "row").agg(F.min("around").alias("around"))
    pairs = written(by_row.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.count_distinct("around").alias("surroundings")))
    entities = pairs.where(F.col("term") == _ITSELF).select("entity", F.col("both").alias("with_entity"))
    least = pairs.where(F.col("entity") == _ANY).select("term", F.col("both").alias("with_any"))
    total = F.lit(float(max(found.count(), 2)))
    reaches = lambda with_term: F.log(F.col("both") * total / (with_term * F.col("with_entity"))) >= DISCLOSURE * F.log(total / F.col("with_entity")) - 1e-9
    supported = pairs.where((F.col("term") != _ITSELF) & (F.col("entity") != _ANY) & (F.col("surroundings") >= SUPPORT)).join(entities, "entity").where(F.col("with_entity") < total)
    supported = written(supported.join(least, "term").where(reaches(F.col("with_any"))).select("term", "both", "with_entity"))
    bits = found.sparkSession.sparkContext.broadcast(bit_map(supported, F.pmod("term", F.lit(2**BITMAP_BITS)), BITMAP_BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for terms, n in _summed(wanted(texts_of(batch.column("text"))) for batch in batches):
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], names=["term", "n"])

    def wanted(texts: Iterator[str]) -> tuple[np.ndarray, np.ndarray]:
        held = [np.empty(0, np.int64)]
        for text in texts:
            h = (word_hashes(_WORD.findall(text.encode("utf-8", "surrogatepass").lower())) ^ np.uint64(2**63)).view(np.int64)
            held.append(np.unique(h[bits_of(bits.value, h & (2**BITMAP_BITS - 1))]))
        return np.unique(np.concatenate(held), return_counts=True)

    terms = found.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("with_term"))
    return supported.join(terms, "term").where(reaches(F.col("with_term"))).select("term").distinct()


def _occurrences(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, places): where words of ``terms`` stand in the rows of ``found``, as starts and ends in code points; not inside an entity."""
    bits = found.sparkSession.sparkContext.broadcast(bit_map(terms, F.pmod("term", F.lit(2**BITMAP_BITS)), BITMAP_BITS))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[int, int, int, int]] = []
            for row, text in zip(batch.column("row").to_pylist(), texts_of(batch.column("text")), strict=True):
                body = text.encode("utf-8", "surrogatepass")
                h = (word_hashes(_WORD.findall(body.lower())) ^ np.uint64(2**63)).view(np.int64)
                met = bits_of(bits.value, h & (2**BITMAP_BITS - 1))
                if met.any():
                    words = [(m.span(), x) for m, x, hit in zip(_WORD.finditer(body), h.tolist(), met.tolist(), strict=True) if hit]
                    inside = _inside(base_spans(body), [w for w, _ in words])
                    at = _points(body, text, [x for w, _ in words for x in w])
                    held += [(row, x, at[s], at[e]) for ((s, e), x), hit in zip(words, inside, strict=True) if not hit]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=["row", "term", "start", "end"])

    places = found.select("row", "text").mapInArrow(look, "row long, term long, start long, end long")
    return places.join(terms, "term", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("places"))


def with_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``; spans by start, then kind."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = written(rows.mapInArrow(_find, _FOUND).withColumn("row", F.monotonically_increasing_id()))
    terms = written(disclosing(found))
    told = _occurrences(found, terms)
    begin = lambda s: F.element_at(F.split(s, ":"), 2).cast("long")
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s, i: F.struct(begin(s).alias("start"), i.alias("rank"), s.alias("span")))
    term = F.transform("places", lambda t: F.struct(t["start"].alias("start"), F.lit(2**31 - 1).alias("rank"), F.concat(F.lit("term:"), t["start"], F.lit(":"), t["end"]).alias("span")))
    spans = F.when(F.col("places").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(base, term)), lambda x: x["span"]), ","))
    return found.join(told, "row", "left").select("doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of ``docs``.

    Defined cases: a null text is empty; an empty text has no spans (the digest of an empty string, an empty ``spans``);
    rows that repeat an id, and rows without one, are searched one by one and count as documents of their own; an empty
    table gives an empty result; other columns are not read. An entity in each document discloses through no word.
    """
    return with_spans(docs).drop("text")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and text of each row of ``docs``: entities generalised to ``[KIND]``, disclosing words removed.

    Defined cases: as :func:`find_personal_data`; each row is cut by its own spans, whatever its id; null texts become empty.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                out, at = [], 0
                for span in filter(None, spans.split(",")):
                    kind, start, end = span.split(":")
                    if int(start) >= at:
                        out += [text[at : int(start)], "" if kind == "term" else f"[{kind.upper()}]"]
                    at = max(at, int(end))
                texts.append("".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return with_spans(docs).select("doc_id", "text", "spans").mapInArrow(clean, "doc_id long, text string")
