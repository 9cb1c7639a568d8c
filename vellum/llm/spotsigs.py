"""Document fingerprints: spot signatures, in DataFrame functions alone.

A spot signature is a common word (the anchor) and the chain of the two content words that follow it. A document's
fingerprint is its whole set of signatures: the size and the sorted 48-bit hashes, so the likeness of two fingerprints is
the Jaccard similarity of the sets themselves, whatever their size.

Sets are partitioned by length: lengths of a partition differ by less than the threshold allows, so a set can only be similar
to those of its own partition and the two beside it. Pairs further apart, and pairs whose lengths alone rule it out, are
pruned before sets are compared. The search for similar documents posts a document, in its partition, under its rarest
signatures only, as many as two sets of the wanted similarity cannot both avoid.

Next documents are found without a global sort of texts: ids alone are range partitioned, each partition finds its own
successors, and the first id of each partition closes the gaps. Texts are shuffled once, by id; a successor sends the first
code points that the edit needs, and its set, to its predecessor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.llm.common import cut_lineage, long_id, text_or_empty, written

#: Similarity from which documents are similar.
THRESHOLD = 0.8
#: Content words of a chain, and words after the anchor among which they are sought.
CHAIN, LOOK = 2, 8
#: Bits of the hash of a signature, a multiple of 24, and its hexadecimal digits.
HASH_BITS = 48
_HEX = HASH_BITS // 4

#: The common words of English, French, German and Spanish that anchor a chain.
ANCHORS = (
    "a", "an", "and", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "which", "with",
    "au", "aux", "avec", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu", "zum",
    "al", "como", "con", "del", "el", "las", "lo", "los", "no", "para", "por", "se", "su", "y",
)


def signatures(words: Column) -> Column:
    """Distinct spot signatures of an array of words; of an array without anchors, its distinct words."""
    anchor = lambda w: w.isin(*ANCHORS)
    chain = lambda w, i: F.slice(F.filter(F.slice(words, i + 2, LOOK), lambda x: ~anchor(x)), 1, CHAIN)
    spots = F.array_distinct(F.array_compact(F.transform(words, lambda w, i: F.when(anchor(w), F.concat(w, F.lit(" "), F.array_join(chain(w, i), " "))))))
    return F.when(F.exists(words, anchor), spots).otherwise(F.array_distinct(words))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashes_of(signs: Column) -> Column:
    """The set of an array of signatures: their distinct hashes in order."""
    return F.sort_array(F.array_distinct(F.transform(signs, lambda s: F.xxhash64(s).bitwiseAND(F.lit(2**HASH_BITS - 1)))))


def write_fingerprint(hashes: Column) -> Column:
    """``size:`` and the hashes of a set, base64 of their bytes."""
    return F.concat(F.size(hashes).cast("string"), F.lit(":"), F.base64(F.unhex(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), _HEX, "0")), ""))))


def likeness(x: Column, y: Column) -> Column:
    """Jaccard similarity of two sets, 0 to 1. Two empty sets are alike."""
    shared = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / F.greatest(union, F.lit(1)).cast("double"))


def length_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """The partition of sets of ``n`` signatures; -1 for empty ones. Similar sets are in the same or in neighbouring partitions."""
    return F.when(n == 0, F.lit(-1)).otherwise(F.floor(F.log(n.cast("double")) / -F.log(F.lit(threshold)) + 1e-9).cast("int"))


def fit(n: Column, m: Column, threshold: float = THRESHOLD) -> Column:
    """Whether sets of ``n`` and ``m`` signatures can be similar at all: neighbouring partitions, then the lengths themselves."""
    return (F.abs(length_partition(n, threshold) - length_partition(m, threshold)) <= 1) & (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9)


def similar(x: Column, y: Column, near: Column, threshold: float = THRESHOLD) -> Column:
    """Whether two sets reach ``threshold``; ``near``, their likeness, is not looked at where their lengths rule it out."""
    return F.when(fit(F.size(x), F.size(y), threshold), near >= threshold - 1e-9).otherwise(F.lit(False))


def _successors(ids: DataFrame) -> DataFrame:
    """next_id of each row of ``ids`` (doc_id distinct, not null): the next greater id, after the greatest the smallest."""
    ranged = cut_lineage(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = W.orderBy("part")
    seams = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("after"))
    inner = F.lead("doc_id").over(W.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("inner", inner).join(F.broadcast(seams), "part").select(*ids.columns, F.coalesce("inner", "after").alias("next_id"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of ``docs``: the operator itself, a projection without a shuffle."""
    worded = docs.select("doc_id", words_of(text_or_empty()).alias("words"))
    signed = worded.select("doc_id", hashes_of(signatures(F.col("words"))).alias("hashes"))
    return signed.select("doc_id", write_fingerprint(F.col("hashes")).alias("fingerprint"))


def search(docs: DataFrame, queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, doc_id, similarity): documents whose whole signature sets reach ``threshold`` with those of ``queries`` (column doc_id).

    Defined cases: texts without words, null ids and ids of ``queries`` that no document has give no rows; rows that
    repeat an id count by the union of their signatures; a document is not similar to itself; empty tables give an empty
    result; other columns are ignored.
    """
    worded = docs.where(F.col("doc_id").isNotNull()).select(long_id(docs), words_of(text_or_empty()).alias("words"))
    spots = worded.select("doc_id", F.explode(hashes_of(signatures(F.col("words")))).alias("sign")).distinct()
    often = spots.groupBy("sign").agg(F.count(F.lit(1)).alias("often"))
    ranked = spots.join(often, "sign").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("often", "sign"))).alias("ranked"))
    n = F.size("ranked")
    needed = F.ceil(n * threshold - 1e-9).cast("int")
    sets = written(ranked.select("doc_id", n.alias("n"), length_partition(n, threshold).alias("part"), (n - needed + 1).alias("prefix"), F.col("ranked.sign").alias("signs")))
    posted = sets.select("doc_id", "n", "part", F.explode(F.slice("signs", F.lit(1), F.col("prefix"))).alias("sign"))
    asked = posted.join(queries.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    probes = asked.select(F.col("doc_id").alias("query_id"), F.col("n").alias("query_n"), "sign", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    pairs = probes.join(posted, ["sign", "part"]).where((F.col("query_id") != F.col("doc_id")) & fit(F.col("n"), F.col("query_n"), threshold)).select("query_id", "doc_id").distinct()
    left = sets.select(F.col("doc_id").alias("query_id"), F.col("signs").alias("query_signs"))
    met = pairs.join(left, "query_id").join(sets.select("doc_id", "signs"), "doc_id")
    shared = F.size(F.array_intersect("signs", "query_signs"))
    told = met.select("query_id", "doc_id", (shared / (F.size("signs") + F.size("query_signs") - shared)).alias("similarity"))
    return told.where(F.col("similarity") >= threshold - 1e-9)


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, length_partition, edited_similar, next_similar of each row of ``docs``.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next document's text.
    Defined cases: a null text is empty; a text without words has an empty set; the only document follows itself; rows
    that repeat an id are edited one by one, have the same next document, and of a repeated next document the smallest
    head, then set, counts; a row with a null id has no next document: its text is cut only, and its near_next is 0.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(long_id(docs), text_or_empty().alias("text"))
    known = rows.where(F.col("doc_id").isNotNull())
    quarter = lambda n: F.floor(n / 4).cast("int")
    sized = known.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    follow = cut_lineage(_successors(sized))
    owners = follow.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("owner"), F.col("n").alias("owner_n"))
    sent = known.join(owners, "doc_id").select("owner", F.substring("text", F.lit(1), quarter(F.col("owner_n"))).alias("head"), words_of(F.col("text")).alias("words"))
    sent = sent.select("owner", "head", hashes_of(signatures(F.col("words"))).alias("after"))
    ahead = sent.groupBy("owner").agg(F.min(F.struct("head", "after")).alias("next")).select(F.col("owner").alias("doc_id"), F.col("next.head").alias("head"), F.col("next.after").alias("after"))
    joined = known.join(ahead, "doc_id").select("doc_id", "text", "head", "after")
    joined = joined.unionByName(rows.where(F.col("doc_id").isNull()).select("doc_id", "text", F.lit("").alias("head"), F.lit(None).cast("array<long>").alias("after")))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter(n)), F.substring("head", F.lit(1), quarter(n)))
    texts = joined.select("doc_id", "after", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    worded = texts.select("doc_id", "after", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), words_of(F.col("text")).alias("words"), words_of(F.col("edited")).alias("edited_words"))
    sets = worded.select("doc_id", "after", "n_chars", "edited_sha256", hashes_of(signatures(F.col("words"))).alias("own"), hashes_of(signatures(F.col("edited_words"))).alias("edit"))
    own, edit, after = F.col("own"), F.col("edit"), F.col("after")
    near = sets.select("*", likeness(own, edit).alias("near_edited"), F.coalesce(likeness(own, after), F.lit(0.0)).alias("near_next"))
    return near.select(
        "doc_id", "n_chars", "edited_sha256", write_fingerprint(own).alias("fingerprint"), write_fingerprint(edit).alias("edited_fingerprint"), "near_edited", "near_next",
        length_partition(F.size(own)).alias("length_partition"), similar(own, edit, F.col("near_edited")).alias("edited_similar"),
        F.coalesce(similar(own, after, F.col("near_next")), F.lit(False)).alias("next_similar"),
    )
