"""Tokens of a text, as a column expression."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that are trimmed off a word, and words that are no tokens.
EDGE_SIGNS = ".,!?;:\"'()[]{}<>@#$%^&*+-=/\\|~`_"
STOP_WORDS = (
    "the", "is", "a", "and", "for", "in", "to", "of", "with", "an", "on", "at", "by", "it", "as", "or", "be", "this", "that", "are", "was", "were", "not",
)
#: All white space of Unicode; the ``\s`` of Java and of RE2 is narrower.
SPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tokens(text: Column) -> Column:
    """array<string>: words in lower case without signs at their ends; stop words and single characters are left out.

    Order and repeats stay, inner dots stay, nothing is stemmed. A null text gives null, an empty one an empty array.
    """
    trimmed = F.transform(F.split(F.lower(text), SPACE_CLASS), lambda w: F.btrim(w, F.lit(EDGE_SIGNS)))
    return F.filter(trimmed, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))


def tokens_of(text: str) -> list[str]:
    """The tokens of one search term, on the driver."""
    words = (word.strip(EDGE_SIGNS) for word in re.split(r"\s+", text.lower()))
    return [word for word in words if len(word) > 1 and word not in STOP_WORDS]


def holds_all(text: Column, wanted: list[str]) -> Column:
    """Whether each of ``wanted`` (tokens) is a token of ``text``; false for none wanted.

    A plain substring test goes first: it is cheap, and rules most rows out before they are split into words.
    """
    if not wanted:
        return F.lit(False)
    wanted = sorted(set(wanted))
    quick = [F.contains(F.lower(text), F.lit(word)) for word in wanted]
    test = F.size(F.array_except(F.array(*map(F.lit, wanted)), tokens(text))) == 0
    for part in reversed(quick):
        test = part & test
    return test


def holds_any(text: Column, wanted: list[str]) -> Column:
    """Whether at least one of ``wanted`` is a token of ``text``; false for none wanted. A substring test goes first, as in :func:`holds_all`."""
    if not wanted:
        return F.lit(False)
    wanted = sorted(set(wanted))
    quick = reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(word)) for word in wanted))
    return quick & F.arrays_overlap(tokens(text), F.array(*map(F.lit, wanted)))
