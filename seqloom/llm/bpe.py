"""Byte-level BPE encoding and decoding in time linear in the text, without running the merges.

A sequence of tokens is what the merges give exactly when every two neighbours are compatible: no merge
joins bytes across their border before both are complete. So a piece is covered from left to right by
the longest vocabulary entry that is compatible with the one before; where none fits, the last one is
taken back and a shorter one tried. Places that lead nowhere are remembered, so each is tried once.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: how the byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces of text, and pairs of tokens, that one task remembers; it starts anew beyond them.
REMEMBERED_PIECES, REMEMBERED_PAIRS = 1 << 19, 1 << 20
LONG_PIECE = 64  # longer pieces are not remembered
LATIN_END = 0x250  # texts of characters below are split by a shorter rule
NONE = -1
_ID = np.dtype("<u4")
_ROWS = 256


def read_ranks(text: str) -> dict[bytes, int]:
    """Vocabulary of a rank file: a line has a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(str.split, text.splitlines())}


def _char_class(name: str, end: int) -> str:
    """The characters of a Unicode class below ``end`` as ranges for ``re``, in the Unicode version of the
    tiktoken library: its own splitter picks them out of the string of all characters."""
    singles = {bytes([i]): i for i in range(256)}
    split = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=singles, special_tokens={})
    whole = "".join(chr(c) for c in range(end) if not 0xD800 <= c < 0xE000)
    found = np.frombuffer(bytes(split.encode_ordinary(whole)).decode().encode("utf-32-le"), _ID)
    cuts = np.flatnonzero(np.diff(found) != 1)
    first, last = found[np.r_[0, cuts + 1]], found[np.r_[cuts, len(found) - 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


def splitter(pattern: str = PATTERN, end: int = 0x110000) -> str:
    """``pattern`` with its classes written out, so that ``re`` splits as the tiktoken library does; for
    texts of characters below ``end`` only, which makes it faster."""
    for name, negated in (("\\p{L}", None), ("\\p{N}", None), ("\\s", "\\S")):
        ranges = _char_class(name, end)
        if negated:
            pattern = pattern.replace(negated, f"[^{ranges}]")
        inside = lambda m, ranges=ranges, name=name: m[0].replace(name, ranges)
        pattern = re.sub(r"\[(?:\\.|[^\]\\])*\]", inside, pattern)
        pattern = pattern.replace(name, f"[{ranges}]")
    return pattern


class Vocabulary:
    """Tokens with their ranks as ids, and the two tokens whose merge made each."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=NONE) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.text = [token.decode("latin-1") for token in self.token]  # a character for each byte
        self.rank = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.left, self.right = [NONE] * size, [NONE] * size
        self.reached = [False] * size  # by merges; others can only be whole pieces
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.reached[rank] = len(token) == 1 or self._made(token.decode("latin-1"), rank)

    def _made(self, token: str, rank: int) -> bool:
        for cut in range(len(token) - 1, 0, -1):
            a, b = self.rank.get(token[:cut], rank), self.rank.get(token[cut:], rank)
            if a < rank and b < rank and self.reached[a] and self.reached[b] and self.compatible(a, b, rank):
                self.left[rank], self.right[rank] = a, b
                return True
        return False

    def compatible(self, a: int, b: int, before: int | None = None) -> bool:
        """Whether merges (of ranks below ``before``) leave the border between ``a`` and ``b`` alone.

        Going back in time, the later one of the two that touch the border is undone. Two that stood
        side by side would have been merged if their merge ranks below that of the one undone last;
        at equal ranks the left place comes first.
        """
        until_left = until_right = len(self.token) if before is None else before - 1
        while True:
            joined = self.rank.get(self.text[a] + self.text[b])
            if joined is not None and joined < until_left and joined <= until_right:
                return False
            made_a = a if self.left[a] != NONE else NONE
            made_b = b if self.left[b] != NONE else NONE
            if made_a == made_b == NONE:
                return True
            if made_a > made_b:
                until_left, a = a, self.right[a]
            else:
                until_right, b = b, self.left[b]


class _Pairs(dict):
    """Whether two tokens may stand side by side, remembered; ``a * size + b`` stands for the pair."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.size = vocabulary, len(vocabulary.token)

    def __missing__(self, pair: int) -> bool:
        if len(self) >= REMEMBERED_PAIRS:
            self.clear()
        value = self[pair] = self.vocabulary.compatible(*divmod(pair, self.size))
        return value


class Merger:
    """Ids of pieces of text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.size = list(map(len, vocabulary.token))
        self.automaton = ahocorasick.Automaton()
        for token, rank in vocabulary.rank.items():
            if vocabulary.reached[rank]:
                self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.fits = _Pairs(vocabulary)

    def _shorter(self, token: int) -> int:
        """The longest token that begins the given one, other than itself."""
        known = self.shorter.get(token)
        if known is None:
            text, v, known = self.vocabulary.text[token], self.vocabulary, NONE
            for end in range(len(text) - 1, 0, -1):
                found = v.rank.get(text[:end], NONE)
                if found != NONE and v.reached[found]:
                    known = found
                    break
            self.shorter[token] = known
        return known

    def ids(self, piece: str) -> list[int]:
        text = piece.encode().decode("latin-1")  # a character for each byte
        whole = self.vocabulary.rank.get(text)
        if whole is not None:
            return [whole]
        n, size, fits, wide = len(text), self.size, self.fits, self.fits.size
        longest = array("i", [NONE]) * n  # token that begins at each place; later ends come later
        for end, token in self.automaton.iter(text):
            longest[end - size[token] + 1] = token
        done: list[int] = []
        dead, at, token = bytearray(n + 1), 0, longest[0]
        while at < n:
            end = at
            while token != NONE:
                end = at + size[token]
                if not dead[end] and (not done or fits[done[-1] * wide + token]):
                    break
                token = self._shorter(token)
            if token != NONE:
                done.append(token)
                at = end
                token = longest[at] if at < n else NONE
            elif done:
                dead[at] = 1
                token = done.pop()
                at -= size[token]
            else:
                raise ValueError("the vocabulary has no token for a byte of the text")
        return done


class _Pieces(dict):
    """Ids of pieces as bytes, each worked out once while it is remembered."""

    def __init__(self, merger: Merger):
        self.merger = merger

    def __missing__(self, piece: str) -> bytes:
        value = array("I", self.merger.ids(piece)).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = value
        return value


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new}
    return pa.RecordBatch.from_arrays([*kept.values(), *new.values()], [*kept, *new])


def _schema(df: DataFrame, new: dict[str, T.DataType]) -> T.StructType:
    kept = [f for f in df.schema if f.name not in new]
    return T.StructType([*kept, *[T.StructField(n, kind) for n, kind in new.items()]])


def _vocabulary(df: DataFrame, ranks_path: str) -> Broadcast:
    """The vocabulary in all tasks; a few MB whatever the input."""
    return df.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(Path(ranks_path).read_text())))


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian in four bytes each) and ``n_tokens``.

    ``ranks_path`` is a rank file that has every single byte; it is read here and sent with the job.
    Each match of ``pattern`` is encoded by itself, text between matches is left out, and strings of
    special tokens are ordinary text: the ids are those of the tiktoken library.

    A null or empty text has no ids. All other columns and all rows pass through, repeated ones and
    those without an id, too; columns named ``ids`` or ``n_tokens`` are replaced. A very long text takes
    about ten times its size in one task; a piece of any length takes time in proportion to it. An
    empty table stays empty.
    """
    shared, latin_rule, rule = _vocabulary(docs, ranks_path), splitter(pattern, LATIN_END), splitter(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, latin, other = _Pieces(Merger(shared.value)).__getitem__, re.compile(latin_rule), re.compile(rule)

        def encoded(body: str) -> bytes:
            split = latin if not body or max(body) < chr(LATIN_END) else other
            return b"".join(map(known, split.findall(body)))

        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids = [encoded(t or "") for t in batch.column(text).to_pylist()]
                counts = pa.array([len(x) // _ID.itemsize for x in ids], pa.int64())
                yield _with_columns(batch, {"ids": pa.array(ids, pa.binary()), "n_tokens": counts})

    return docs.mapInArrow(run, _schema(docs, {"ids": T.BinaryType(), "n_tokens": T.LongType()}))


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes that ``ids`` stand for (binary; null ids stay null).

    Bytes need not be whole characters, so they are not a string. Ids outside the vocabulary stop the
    job. Other columns pass through; one named ``decoded`` is replaced.
    """
    shared = _vocabulary(tokens, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value.token
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                out = [
                    None if x is None else b"".join(map(token.__getitem__, np.frombuffer(x, _ID).tolist()))
                    for x in batch.column(ids).to_pylist()
                ]
                yield _with_columns(batch, {"decoded": pa.array(out, pa.binary())})

    return tokens.mapInArrow(run, _schema(tokens, {"decoded": T.BinaryType()}))
