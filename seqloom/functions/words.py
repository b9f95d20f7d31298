"""Word and n-gram functions. Words are runs of Unicode letters, digits and underscores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.arrays import let

WORD = r"([\p{L}\p{N}_]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def ngrams(word_list: Column, n: int) -> Column:
    """The set of word n-grams of an array column of words.

    A text shorter than ``n`` words gives one gram of all its words, an empty one gives none.
    """

    def grams(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(found) - (n - 1), F.lit(1)))
        every = F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))
        return F.when(F.size(found) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(word_list, grams)


def hashed_ngrams(word_list: Column, n: int) -> Column:
    """:func:`ngrams` as 64-bit hashes over the hashes of their words; no gram is built as text."""

    def grams(found: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(found) - n, F.lit(0)))
        # A place behind the last word is null, which the hash passes over.
        every = F.transform(starts, lambda i: F.xxhash64(*[F.get(found, i + j) for j in range(n)]))
        return F.when(F.size(found) > 0, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), grams)


def lexical_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """Jaccard and containment (share of the smaller set) of two gram sets; empty sets give 0."""
    shared = F.size(F.array_intersect(a, b))
    either_empty = (F.size(a) == 0) | (F.size(b) == 0)
    jaccard = F.try_divide(shared, F.size(a) + F.size(b) - shared)
    containment = F.try_divide(shared, F.least(F.size(a), F.size(b)))
    return (
        F.when(either_empty, 0.0).otherwise(jaccard),
        F.when(either_empty, 0.0).otherwise(containment),
    )


def join_text(available: Sequence[str], keys: Sequence[str]) -> Column:
    """The keys that exist, nulls as empty text, joined by one space and trimmed."""
    present = [k for k in keys if k in available]
    if not present:
        raise ValueError(f"none of the text keys {list(keys)} is in {list(available)}")
    return F.trim(F.array_join(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in present]), " "))
