"""MinHash near-dedup by an inverted join over signature coordinates.

A signature has 64 coordinates, and each (coordinate, value) pair is a token under which documents are posted. Two
documents at the wanted similarity agree on fewer coordinates than the match threshold a few times in a million pairs (40 of 64 for a
similarity of 0.85). A pair with that many tokens in common shares one of the first ``64 - threshold + 1`` tokens of either
document in any common order of tokens; with frequent tokens last (a fixed-size count sketch gives the order) only that
prefix is merged, and the long lists behind it are skipped and merely counted when a pair is met.

A list of at most ``SMALL`` documents gives its pairs. A longer one, as large groups of copies make it, takes a leader, the
one that most of its documents share with other lists, and gives one pair per member. Members that the links of leaders and
of short lists put into one component need nothing more. Of the others' pairs, one is outside the component that most members
of the star are in; call it minor. Say i is minor and |i - j| <= D (symmetric differences, D from the similarity), and not both
are linked to the leader: their differences from the leader share an element, and in any common order of elements the first
that they share stands at places p and q with p + q + |(|di| - p) - (|dj| - q)| <= D. So each difference is posted under its
first D + 1 elements, those that few minor members have first; elements that no minor member has are left out, and so are
lists of one component and postings that nothing in their list can meet within D. Lists of an element with few minor members
give the pairs of these, where a bit map of both differences lets them be links; the other lists are stars again, with a leader
of their own and fewer members, until none is left. What counts as few grows by the round up to a bound, as dense groups are
joined in the first rounds. No group is held in one task, no group emits all its pairs, and each round emits rows in proportion
to its members.

Every link is confirmed on the full shingle sets; these are built where the texts are read, for documents that a bit map of
fixed size lets through.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import WHITE, bit_map, bits_of, bound_batches, cut_lineage, slices_of, text_or_empty, texts_of, written
from vellum.llm.components import components
from vellum.llm.shingles import digest, mix, shingle_set, words

COORDINATES = 64
#: Similarity, as hundredths of the union that the intersection must reach, where a caller names none.
PERCENT = 80
#: Chance that a pair at the wanted similarity agrees on fewer coordinates than the match threshold, at most.
MISS = 4e-6
#: Longest posting list that gives all its pairs, and most minor members of a list of an element that gives theirs: in the first round, from one to the next, and at most.
SMALL = 16
MEET_FIRST, MEET_GROWTH, MEET_MOST = 256, 4, 1024
#: 64-bit words of the bit map of a difference; two maps differ in no more bits than their differences do in elements.
MAP_WORDS = 4
#: Counters of the sketches of tokens and elements; they only order them, so collisions cost time and never a link.
SKETCH_BITS = 20
#: Bits of the map that tells which documents may need their shingle set; a set bit is confirmed by a join.
MAP_BITS = 26

_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 4096


@functools.cache
def matches(percent: int) -> int:
    """Coordinates that a pair at ``percent`` agrees on, but for a chance of ``MISS``."""
    chance, fewer = percent / 100, 0.0
    for m in range(COORDINATES):
        fewer += math.comb(COORDINATES, m) * chance**m * (1 - chance) ** (COORDINATES - m)
        if fewer > MISS:
            return m
    return COORDINATES


def signature(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit token for each coordinate; it names the coordinate and its value."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK, None] * _MULTIPLY + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least + _ADD)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in texts_of(batch.column("text")):
            found = words(text)
            shingles = shingle_set(found)
            sizes.append(len(shingles))
            digests.append(digest(found) if found else None)
            signatures.append(signature(shingles).tobytes() if found else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "signature"],
        )


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), COORDINATES)


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(df: DataFrame, tokens_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often the tokens of the batches of ``df`` occur, by bucket; at most 2^20 numbers reach the driver, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**SKETCH_BITS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_bucket(tokens_of(batch)), minlength=len(total))
        there = np.flatnonzero(total)
        for at in range(0, len(there), 100_000):
            some = there[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = df.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2**SKETCH_BITS, np.int64)
    out[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return out


def _post(classes: DataFrame, prefix: int) -> DataFrame:
    """(token, node, weight): each document under its first ``prefix`` tokens; weight is high where tokens are common."""
    sketch = classes.sparkSession.sparkContext.broadcast(_sketch(classes.select("signature"), lambda batch: _matrix(batch.column("signature")).ravel()))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for batch in slices_of(batches, 2048):
            tokens = _matrix(batch.column("signature"))
            freq = often[_bucket(tokens)]
            order = np.argsort((freq.astype(np.uint64) << np.uint64(20)) | (tokens & np.uint64(0xFFFFF)), axis=1, kind="stable")[:, :prefix]
            tokens, near = np.take_along_axis(tokens, order, 1), np.take_along_axis(freq, order, 1)
            weight = np.minimum(freq.sum(axis=1), 2**46) * 65536 + (tokens[:, 0] & np.uint64(0xFFFF)).astype(np.int64)
            shared = near.ravel() > 1
            rows = np.repeat(np.arange(batch.num_rows), prefix)[shared]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.ravel()[shared].view(np.int64)), batch.column("node").take(pa.array(rows)), pa.array(weight[rows])], names=["token", "node", "weight"]
            )

    return classes.select("node", "signature").mapInArrow(post, "token long, node long, weight long")


def _lists(classes: DataFrame, prefix: int) -> DataFrame:
    """The postings with the length and the leader of their list."""
    posted = written(_post(classes, prefix))
    lists = written(posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", "weight").alias("leader")).where("n > 1"))
    return posted.select("token", "node").join(lists, "token")  # of two tables, so that Spark can split a long list or broadcast few


def _stars(lists: DataFrame) -> DataFrame:
    """(a, b): the leader of each long list with its members. Lists that share members share a leader, the one with most of them, so a member has few."""
    large = lists.where(F.col("n") > SMALL).select("token", "node", "leader")
    led = large.select("leader", "node").distinct()
    followers = led.groupBy("leader").agg(F.count(F.lit(1)).alias("followers"))
    first = led.join(followers, "leader").groupBy("node").agg(F.max(F.struct("followers", "leader")).alias("first"))
    chosen = written(large.join(first, "node").groupBy("token").agg(F.max("first").alias("first")).select("token", F.col("first.leader").alias("a")))
    return large.select("token", F.col("node").alias("b")).join(chosen, "token").where("a <> b").select("a", "b").distinct()


def _small_pairs(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs within short lists that ``comps`` (node, component) has not joined yet."""
    known = lists.where(F.col("n") <= SMALL).join(comps, "node", "left").select("token", F.struct("node", F.coalesce("component", "node").alias("comp")).alias("x"))
    members = known.groupBy("token").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    members = members.where(F.size(F.array_distinct(F.col("xs.comp"))) > 1)
    later = F.filter("xs", lambda y: (y["node"] > F.col("x.node")) & (y["comp"] != F.col("x.comp")))
    pairs = members.select("xs", F.explode("xs").alias("x")).select(F.col("x.node").alias("a"), F.explode(later).alias("y"))
    return pairs.select("a", F.col("y.node").alias("b")).distinct()


def _agree(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree on at least ``least`` coordinates."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, 4096):
            if batch.num_rows:
                same = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).sum(axis=1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(same))

    left, right = (classes.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(agree, "a long, b long")


def _most(size: np.ndarray | int, percent: int) -> int:
    """Largest symmetric difference of linked sets whose sizes sum to ``size``."""
    return size * (100 - percent) // (100 + percent)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, star: bool) -> DataFrame:
    """a, b, linked; for a star (a is the leader) also n (size of b's set) and delta, the symmetric difference of both sets."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches):
            linked, sizes, deltas = [], [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if star:
                    delta = np.setxor1d(left, right, assume_unique=True)
                    common = (len(left) + len(right) - len(delta)) // 2
                    sizes.append(len(right))
                    deltas.append(delta.tobytes())
                else:
                    common = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * common >= percent * (len(left) + len(right) - common))
            out = [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())]
            if star:
                out += [pa.array(sizes, pa.int64()), pa.array(deltas, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["a", "b", "linked", "n", "delta"][: len(out)])

    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long, linked boolean" + ", n long, delta binary" * star)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def _slot(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(2**MAP_BITS))


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles): full shingle sets of ``nodes``. Texts are not shuffled, unless a share of them that fills the map is wanted."""
    wanted = written(classes.join(nodes, "node", "left_semi").select("node", "rep", "digest"))
    held = bit_map(wanted, _slot("rep"), MAP_BITS)
    if np.bitwise_count(held.view(np.uint64)).sum() > 2 ** (MAP_BITS - 1):  # a map this full lets most texts through; the ids themselves then choose
        docs = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bits = docs.sparkSession.sparkContext.broadcast(held)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words64 = bits.value
        for batch in batches:
            batch = batch.filter(pa.array(bits_of(words64, batch.column("slot").to_numpy())))
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [words(text) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([digest(x) for x in found], pa.binary()), pa.array([shingle_set(x).tobytes() for x in found], pa.binary())], names=["rep", "digest", "shingles"]
                )

    built = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", _slot("doc_id").alias("slot")).mapInArrow(build, "rep long, digest binary, shingles binary")
    return built.join(wanted, ["rep", "digest"]).select("node", "shingles").dropDuplicates(["node"])


def _open_members(told: DataFrame, comps: DataFrame) -> DataFrame:
    """The members of stars whose members are in more than one component so far, with their component; minor are those outside the component that most have."""
    named = told.join(comps, told["b"] == comps["node"], "left").select(F.col("a").alias("leader"), F.col("b").alias("member"), "linked", "n", "delta", F.coalesce("component", "b").alias("comp"))
    held = named.groupBy("leader", "comp").agg(F.count(F.lit(1)).alias("many"), F.min("linked").alias("settled"))
    unsettled = held.groupBy("leader").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("many", "comp")).alias("main"), F.min("settled").alias("settled")).where("comps > 1 and not settled")
    return named.join(written(unsettled.select("leader", F.col("main.comp").alias("main"))), "leader").withColumn("minor", F.col("comp") != F.col("main")).drop("main")


def _element_tokens(batch: pa.RecordBatch) -> np.ndarray:
    """A token for each (leader, element of a difference), row after row."""
    deltas = batch.column("delta").to_pylist()
    leaders = np.repeat(batch.column("leader").to_numpy().view(np.uint64), [len(d) // 8 for d in deltas])
    return mix(np.frombuffer(b"".join(deltas), np.uint64) + leaders * _ODD)


def _shared_elements(members: DataFrame, percent: int) -> DataFrame:
    """leader, element, at (place in the member's difference, rare elements first), and what is known of the member; elements that no minor member has are left out."""
    sketch = members.sparkSession.sparkContext.broadcast(_sketch(members.where("minor").select("leader", "delta"), _element_tokens))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for batch in slices_of(batches):
            tokens = _element_tokens(batch)
            freq = often[_bucket(tokens)]
            rows, places, found, begin = [], [], [], 0
            maps = np.zeros((batch.num_rows, MAP_WORDS * 64), bool)
            for row, (delta, n) in enumerate(zip(batch.column("delta"), batch.column("n").to_pylist(), strict=True)):
                end = begin + len(delta.as_buffer()) // 8
                order = np.lexsort((tokens[begin:end], freq[begin:end]))[: _most(n + 100 * n // percent, percent) + 1]
                at = np.flatnonzero(freq[begin:end][order] > 0)
                rows.append(np.full(len(at), row))
                places.append(at)
                found.append(tokens[begin:end][order[at]])
                maps[row, (tokens[begin:end] & np.uint64(MAP_WORDS * 64 - 1)).astype(np.int64)] = True
                begin = end
            rows = np.concatenate(rows)
            sizes = np.array([len(d.as_buffer()) // 8 for d in batch.column("delta")], np.int64)
            taken = batch.select(["leader", "member", "linked", "n", "comp", "minor"]).take(pa.array(rows))
            bits = np.packbits(maps, axis=1).view(np.int64)[rows]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(sizes[rows]), pa.array(np.concatenate(places)), pa.array(np.concatenate(found).view(np.int64)), *(pa.array(bits[:, k].copy()) for k in range(MAP_WORDS))],
                names=["leader", "member", "linked", "n", "comp", "minor", "n_delta", "at", "element", *(f"map{k}" for k in range(MAP_WORDS))],
            )

    maps_schema = "".join(f", map{k} long" for k in range(MAP_WORDS))
    return members.mapInArrow(post, "leader long, member long, linked boolean, n long, comp long, minor boolean, n_delta long, at long, element long" + maps_schema)


def _meetings(members: DataFrame, percent: int) -> DataFrame:
    """Postings of elements that can still make a link, with the length, the number of minor members and the leader of their list."""
    posted = written(_shared_elements(members, percent))
    keys, minor, rest = ["leader", "element"], F.col("minor"), F.col("n_delta") - F.col("at")
    lists = posted.groupBy(*keys).agg(
        F.count_if(minor).alias("minors"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("linked").alias("settled"),
        F.min("at").alias("first"), F.min(rest).alias("least"), F.max(rest).alias("most"),
        *(f(F.when(minor, x)).alias(f"minor_{name}") for f, x, name in [(F.min, F.col("at"), "first"), (F.min, rest, "least"), (F.max, rest, "most")]),
        F.min_by("member", F.col("n_delta") * 2**32 + F.pmod("member", F.lit(2**32))).alias("next_leader"),
    )
    lists = written(lists.where("minors > 0 and low < high and not settled").drop("low", "high", "settled"))
    # others that a minor member can meet are all of its list, those of any other member are the minor ones
    first, least, most = (F.when(minor, F.col(name)).otherwise(F.col(f"minor_{name}")) for name in ("first", "least", "most"))
    apart = F.col("at") + first + F.greatest(F.lit(0), rest - most, least - rest)
    met = posted.join(lists, keys).where(apart * (100 + percent) <= (F.col("n") + F.floor(F.col("n") * 100 / percent)) * (100 - percent))
    return met.drop("first", "least", "most", "minor_first", "minor_least", "minor_most")


def _pairs_that_met(met: DataFrame, percent: int) -> DataFrame:
    """Pairs of a minor member and another in lists of elements that can be links, going by where the element stands in both differences and by their bit maps."""
    x, y = met.where("minor").alias("x"), met.alias("y")
    apart = F.greatest(
        F.col("x.at") + F.col("y.at") + F.abs((F.col("x.n_delta") - F.col("x.at")) - (F.col("y.n_delta") - F.col("y.at"))),
        reduce(Column.__add__, (F.bit_count(F.col(f"x.map{k}").bitwiseXOR(F.col(f"y.map{k}"))).cast("long") for k in range(MAP_WORDS))),
    )
    can = (
        (F.col("x.leader") == F.col("y.leader")) & (F.col("x.element") == F.col("y.element")) & (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.minor") | (F.col("x.member") < F.col("y.member")))
        & ~(F.col("x.linked") & F.col("y.linked")) & (apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent))
    )
    return x.join(y, can).select(F.least("x.member", "y.member").alias("a"), F.greatest("x.member", "y.member").alias("b")).distinct()


def _links_of_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The links among ``pairs``, and ``sets`` with the shingle sets that they took besides."""
    pairs = cut_lineage(_agree(pairs, classes, matches(percent)))
    sets = sets.union(cut_lineage(_sets(docs, classes, _ends(pairs).join(sets, "node", "left_anti"))))
    return cut_lineage(_confirm(pairs, sets, percent, star=False).where("linked").select("a", "b")), sets


def _linked_nodes(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that links reach."""
    lists = written(_lists(classes, COORDINATES - matches(percent) + 1))
    stars = cut_lineage(_stars(lists))
    sets = cut_lineage(_sets(docs, classes, _ends(stars)))
    told = cut_lineage(_confirm(stars, sets, percent, star=True))
    links = told.where("linked").select("a", "b")
    comps = components(links)
    more, sets = _links_of_pairs(docs, classes, _small_pairs(lists, comps), sets, percent)
    links = links.union(more)
    comps = components(links)
    met_pairs: list[DataFrame] = []
    short = MEET_FIRST
    while not told.isEmpty():  # a star has fewer members than the one of the round before that it is part of
        met = written(_meetings(cut_lineage(_open_members(told, comps)), percent))
        met_pairs.append(_pairs_that_met(met.where(F.col("minors") <= short), percent))
        stars = met.where((F.col("minors") > short) & (F.col("member") != F.col("next_leader"))).select(F.col("next_leader").alias("a"), F.col("member").alias("b")).distinct()
        told = cut_lineage(_confirm(stars, sets, percent, star=True))
        links = links.union(told.where("linked").select("a", "b"))
        short = min(short * MEET_GROWTH, MEET_MOST)
    if not met_pairs:
        return comps
    more, _ = _links_of_pairs(docs, classes, reduce(DataFrame.union, met_pairs).distinct(), sets, percent)
    return components(links.union(more))


def _classes(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the digest of their words, and the classes of equal digests: digest, rep (smallest id), component_id, component (of classes that links join)."""
    bound_batches(rows.sparkSession)
    signed = written(rows.mapInArrow(_sign, "doc_id long, n_shingles long, digest binary, signature binary"))
    words_only = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = words_only.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    nodes = cut_lineage(_linked_nodes(rows, classes, percent).join(classes.select("node", "rep"), "node"))
    least = nodes.groupBy("component").agg(F.min(F.struct("rep", "node")).alias("least"))
    named = nodes.join(least, "component").select("node", F.col("least.rep").alias("component_id"), (F.col("least.node") == F.col("node")).alias("first"))
    named = classes.select("node", "digest", "rep").join(named, "node", "left")
    return signed, named.select("digest", "rep", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents whose sets of 5-word shingles have 100 * intersection >= percent * union are linked; component_id is the
    smallest id that links reach, the own id included, and the document with that id is kept.

    Defined cases: a null text is empty; a text without words has no shingles, is linked with nothing and is kept; fewer
    than five words make one shingle. Equal word sequences are one class and are compared once. A row with a null id can
    join the component of a class that has ids, and has a null component_id otherwise. Rows that repeat an id are linked
    by their own texts. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed, classes = _classes(rows, percent)
    own = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "component_id"), "digest", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component of near copies, the one with the smallest id; columns and their order stay.

    Rows are told apart by their words, never by their id. Defined cases: rows without words (null, empty or white texts)
    all stay; of rows with equal words one stays, the smallest id, then the least hash of the text, a null id only where no other row has
    one; rows that share an id and differ in words stay both unless they are near copies; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    lost = _classes(rows, percent)[1].where(~F.col("first")).select(F.hex("digest").alias("key"))
    text = text_or_empty(text_col)
    plain = F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    row, rank = F.struct(*(docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(docs.columns))), F.struct(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.xxhash64(text))
    worded = F.length(F.translate(text, WHITE, "")) > 0
    folded = docs.where(worded).select(F.upper(F.md5(plain)).alias("key"), row.alias("row"), rank.alias("rank")).groupBy("key").agg(F.min_by("row", "rank").alias("row"))
    kept = folded.join(lost, "key", "left_anti").select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)))
    return kept.union(docs.where(~worded))
