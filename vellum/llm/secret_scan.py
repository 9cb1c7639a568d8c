"""Secret scans: fixed patterns, and novelty measured with a dictionary-primed zstandard compressor.

A candidate of the second kind is a long run of token characters, with letters and digits, that follows a word of
sensitive context. It is compressed with the code around it and a dictionary of identifiers as history; what it adds in
bytes says how much of it neither the identifiers nor its surroundings explain. Random keys stay as long as they were;
names, paths and repeated values shrink.

The dictionary is learnt from the corpus: names and their words in the surroundings of all sensitive contexts, counted by
document with sums inside tasks, of which the ``DICTIONARY`` most frequent are kept. Names have
digits at their end alone, so keys that documents repeat do not become identifiers. A second pass finds the spans; memory is that of one batch.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import bound_batches, slices_of, text_or_empty, texts_of

KINDS = ("assign", "access", "hex", "novel")
#: Bytes before and after a candidate that count as its surroundings.
SURROUNDINGS = 512
#: Bytes after a context word in which a candidate may begin.
REACH = 48
#: A candidate is novel from this share of the compressed bytes that random strings of its alphabet and length take.
RANDOM_SHARE = 0.95
#: Names and words of names that the dictionary keeps, documents that each is in at least, and the longest name.
DICTIONARY, DICTIONARY_DOCUMENTS, LONGEST_NAME = 1024, 3, 48
#: Random strings that are tried, and the length from which the entropy of the alphabet stands for them.
SAMPLES, LONG = 16, 4096
REDACTED = "[SECRET]"

#: Words of sensitive context, and common identifiers that the dictionary begins with.
CONTEXT = ("secret", "token", "passw", "pwd", "credential", "private_key", "privatekey", "api_key", "apikey", "api-key", "access_key", "accesskey", "auth", "bearer", "signature")
IDENTIFIERS = (
    "import from class def return self public private static final void string integer boolean function const let var new null true false "
    "include namespace package interface extends implements throws exception error message request response server client config "
    "settings environment production development localhost http https www com org net example user username email password token secret "
    "access key api_key auth authorization bearer session cookie header content-type application/json text/html utf-8 base64 sha256 md5 "
    "version build release test debug info warning path file name value data list array object index count size length type id uuid "
    "database table column select insert update delete where order limit host port address timeout retry connection default "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000 xxxxxxxx placeholder changeme"
)

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_CONTEXT = re.compile("|".join(map(re.escape, CONTEXT)).encode())
#: Bytes of a candidate at least.
SHORTEST = 16
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.-]{%d,}" % SHORTEST)
#: Names, of letters with a few digits behind them at most, and the words that make them up.
_NAME = re.compile(rb"(?<![A-Za-z0-9+/=])[A-Za-z][A-Za-z_.-]*[0-9]{0,3}(?![A-Za-z0-9+/=])")
_PART = re.compile(rb"[A-Z]?[a-z]{3,15}|[A-Z]{4,15}")
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets of keys, small ones first: hexadecimal, base32, digits with one case or both, base64 and what else a candidate holds.
_ALPHABETS = (
    _DIGITS + b"ABCDEF", _DIGITS + b"abcdef", _UPPER + b"234567", _UPPER.lower() + b"234567", _DIGITS + _UPPER, _DIGITS + _UPPER.lower(),
    _DIGITS + _UPPER + _UPPER.lower(), _DIGITS + _UPPER + _UPPER.lower() + b"+/",
)


def _marginal(value: bytes, around: bytes, words: bytes) -> float:
    """Compressed bytes of ``value``, a byte, with the dictionary (``words`` and the fixed ones) and ``around`` as history."""
    history = zstandard.ZstdCompressionDict(b"\n".join([words, IDENTIFIERS.encode(), around]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed = zstandard.ZstdCompressor(level=19, dict_data=history, write_checksum=False, write_content_size=False)
    return (len(primed.compress(value)) - len(primed.compress(b""))) / len(value)


def novelty(body: bytes, start: int, end: int, words: bytes = b"") -> float:
    """Marginal compressed bytes of ``body[start:end]``, a byte."""
    return _marginal(body[start:end], body[max(0, start - SURROUNDINGS) : start] + b"\n" + body[end : end + SURROUNDINGS], words)


@functools.lru_cache(4096)
def _random_cost(alphabet: bytes, length: int) -> float:
    """The least that some random strings take, compressed, a byte."""
    if length > LONG:
        return math.log2(len(alphabet)) / 8
    r = random.Random(length)
    return min(_marginal(bytes(r.choices(alphabet, k=length)), b"", b"") for _ in range(SAMPLES))


def is_novel(body: bytes, start: int, end: int, words: bytes = b"") -> bool:
    """Whether a candidate has letters, digits and variety, and compresses no further than random strings of its alphabet and length."""
    value = body[start:end]
    if not (re.search(rb"[0-9]", value) and re.search(rb"[A-Za-z]", value) and len(set(value)) >= 8):
        return False
    core = value.strip(b"+/_=.-") or value
    alphabet = next((a for a in _ALPHABETS if not core.translate(None, a)), _ALPHABETS[-1])
    found = novelty(body, start, end, words)
    return found >= RANDOM_SHARE * max(math.log2(len(alphabet)) / 8, _random_cost(alphabet, end - start))


def names_near_contexts(body: bytes) -> set[bytes]:
    """Names in the surroundings of sensitive contexts, without the digits at their ends, and the words that make them up."""
    found: set[bytes] = set()
    done = 0
    for context in _CONTEXT.finditer(body.lower()):
        low, high = max(done, context.start() - SURROUNDINGS), context.end() + SURROUNDINGS
        for name in _NAME.findall(body, low, high):
            if len(name) <= LONGEST_NAME:
                found.add(name.rstrip(b"0123456789_.-"))
                found.update(_PART.findall(name))
        done = max(done, context.end())
    return found


def learn_dictionary(texts: DataFrame) -> bytes:
    """The most frequent names and words of names near sensitive contexts of all of ``texts`` (column text), the most frequent last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: Counter[bytes] = Counter()
            for text in texts_of(batch.column("text")):
                met.update(names_near_contexts(text.encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in met], pa.string()), pa.array(met.values(), pa.int64())], names=["word", "n"])

    counts = texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= DICTIONARY_DOCUMENTS)
    return " ".join(r.word for r in reversed(counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect())).encode()


def base_spans(body: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns. All of them are ASCII, so bytes give the spans that code points do."""
    found = []
    small = body.lower()
    if any(word in small for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(body) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in body:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(body) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(body)]
    return found


def novel_spans(body: bytes, taken: list[tuple[int, int, int]], words: bytes = b"") -> list[tuple[int, int, int]]:
    """Incompressible strings in sensitive context that no span of ``taken`` touches."""
    found, after = [], 0
    for context in _CONTEXT.finditer(body.lower()):
        at = max(after, context.end())
        # a candidate begins within REACH, and is as long as it is
        while candidate := _CANDIDATE.search(body, at, max(at, context.end() + REACH + SHORTEST)):
            start, end = _CANDIDATE.match(body, candidate.start()).span()
            at = after = end
            inner = start + body[start:end].rstrip(b"=").rfind(b"=") + 1
            for begin in sorted({start, inner}):
                if end - begin >= SHORTEST and not any(s < end and begin < e for s, _, e in taken) and is_novel(body, begin, end, words):
                    found.append((begin, 3, end))
                    break
    return found


def scan(text: str, words: bytes = b"") -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind, end) in code points, by start, then kind; ``words`` are the learnt dictionary."""
    body = text.encode("utf-8", "surrogatepass")
    base = base_spans(body)
    spans = sorted(base + novel_spans(body, base, words))
    if len(body) != len(text):
        at, seen, points = 0, 0, {}
        for edge in sorted({x for s, _, e in spans for x in (s, e)}):
            seen += len(body[at:edge].decode("utf-8", "surrogatepass"))
            at, points[edge] = edge, seen
        spans = [(points[s], k, points[e]) for s, k, e in spans]
    return spans


def spell(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span, or union of spans that touch, replaced by ``[SECRET]``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of ``docs``.

    Defined cases: a null text is empty; an empty text has no spans (the digest of an empty string, an empty ``spans``);
    null and repeated ids pass through row by row; an empty table gives an empty result; other columns are not read; a
    candidate of any length is taken whole.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    words = learn_dictionary(rows)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spelled = ([], [], []), [], []
            for text in texts_of(batch.column("text")):
                spans = scan(text, words)
                base = [x for x in spans if x[1] < 3]
                for kind, column in enumerate(counts):
                    column.append(sum(x[1] == kind for x in base))
                digests.append(hashlib.sha256(spell(base, KINDS).encode()).hexdigest())
                spelled.append(spell(spans, KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spelled, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return rows.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; ``n_chars``, if there, follows a new text. Clean rows stay as they are.

    Defined cases: a null text stays null; null and repeated ids make no difference, each row is cut by its own spans; an
    empty table gives an empty result; no column is added on the way, so none can clash.
    """
    bound_batches(docs.sparkSession)
    out = docs.withColumn("text", F.col("text").cast("string"))
    words = learn_dictionary(out.select(text_or_empty().alias("text")))
    at, size_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            texts, sizes = [], {}
            for row, text in enumerate(texts_of(batch.column(at))):
                texts.append(None if text is None else redact(text, scan(text, words)))
                if texts[-1] != text:
                    sizes[row] = len(texts[-1])
            if sizes:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if size_at is not None:
                    new = [sizes.get(row, size) for row, size in enumerate(batch.column(size_at).to_pylist())]
                    batch = batch.set_column(size_at, batch.schema.field(size_at), pa.array(new, batch.schema.field(size_at).type))
            yield batch

    return out.mapInArrow(clean, out.schema)
