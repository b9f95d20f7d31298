"""Words of texts: runs of characters other than space and U+0009 to U+000D."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Distinct words whose hashes one task remembers; it starts anew beyond them.
REMEMBERED_WORDS = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until it clashes with none of those taken (in either case)."""
    used, found = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


def words_of(text: Column) -> Column:
    """Array of the words of a text; null has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def word_count(text: Column) -> Column:
    """Number of words, null counting as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(text: str | None) -> list[bytes]:
    """The same words in Python, as UTF-8. ``bytes.split`` takes exactly the characters of SPACE."""
    return (text or "").encode().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[2])
    return h ^ (h >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` neighbours; none if there are fewer.

    Runs are doubled: the hash of 2k neighbours comes from two hashes of k, so the work grows with
    the logarithm of the width.
    """
    if len(hashes) < width:
        return hashes[:0]
    done, size = hashes[: len(hashes) - width + 1] * np.uint64(0), 0  # what is hashed so far of each run
    block, length, rest = mixed(hashes + np.uint64(_MIX[0])), 1, width
    while rest:
        if rest & 1:
            part = block[size : size + len(done)]
            done = mixed(done * np.uint64(_MIX[0]) + part + np.uint64(length))
            size += length
        rest >>= 1
        if rest:
            block = mixed(block[:-length] * np.uint64(_MIX[0]) + block[length:] + np.uint64(length))
            length *= 2
    return done
