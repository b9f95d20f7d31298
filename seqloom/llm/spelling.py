"""Grouping of spelling variants: words one edit apart, found by dense comparison of blocks of words.

Words stand as rows of padded matrices of code points, once from the front and once from the back. Of
two blocks all common prefixes and suffixes come out at once; two words are one edit apart where both
together reach the longer length minus one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.session import materialize

# Letters of words (without digits), and the letters that are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, FACTOR, NOISE = 7, 2, 10, 31
GROUP_WORDS = 4096  # larger groups of words are divided by more of their letters
TILE_CELLS = 1 << 18  # code points compared at once
TILE_WORDS = 64
_KEY = ("length", "head", "tail", "front", "back")


def noisy_words(
    docs: DataFrame, noise: int | None = NOISE, min_length: int = MIN_LENGTH, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``word``: one row for each run of letters of ``min_length`` or more code points, lower-cased in A-Z.

    With ``noise``, where it divides the CRC-32 of ``<doc_id>:<run>`` the code point at that number
    modulo the run's length is left out; a run that is too short then is none. A null id is empty.
    """
    # Greedy, so a match is a whole run; shorter runs stay too short whatever is left out.
    found = F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), found)
    # Most runs have no capital.
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", run.alias("word"))
    if noise is None:
        return runs.select("word")
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
    at = (F.col("h") % F.length("word")).cast("int")
    shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
    runs = runs.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("word")).alias("word"))
    return runs.filter(F.length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words with their number ``n``, of ``min_count`` at least."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _keyed(rows: DataFrame, choices: list[tuple[Column, Column, Column]]) -> DataFrame:
    """A row for each choice of (length class, letters in front, letters at the back) and the letters there."""
    parts = F.array(*[F.struct(k.alias("length"), h.alias("head"), t.alias("tail")) for k, h, t in choices])
    rows = rows.select("word", "n", F.explode(parts).alias("c")).select("word", "n", "c.*")
    front = F.substr("word", F.lit(1), F.col("head"))
    back = F.substr("word", F.length("word") - F.col("tail") + 1, F.col("tail"))
    return rows.withColumns({"front": front, "back": back})


def _groups(words: DataFrame) -> DataFrame:
    """The groups in which pairs are looked for: ``word``, ``n`` and the group's key.

    A pair belongs to the length of its shorter word. Its edit lies either behind the first half of that
    length, then both begin alike, or before, then both end alike; so a word is in four groups. The
    place of the edit (the common prefix) decides which group reports a pair. A group of more than
    GROUP_WORDS words is divided the same way at half of the letters between head and tail. Where only
    one place is left, a group has at most about twice as many words as there are letters.
    """
    n = F.length("word")
    half = lambda k: F.floor(k / 2).cast("int")
    whole = lambda k: [(k, half(k), F.lit(0)), (k, F.lit(0), k - half(k))]
    rows = _keyed(words, [*whole(n), *whole(n - 1)])
    done = []
    while True:
        rows = materialize(rows, "word-groups")
        large = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("words"))
        large = large.filter((F.col("words") > GROUP_WORDS) & (F.col("length") - F.col("head") - F.col("tail") > 1))
        large = materialize(large.select(*_KEY), "large-groups")
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, list(_KEY), "left_anti"))
        head, tail, size = F.col("head"), F.col("tail"), F.col("length")
        more = head + F.ceil((size - head - tail) / 2).cast("int")
        rows = _keyed(rows.join(large, list(_KEY), "left_semi"), [(size, more, tail), (size, head, size - more)])
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").reshape(len(words), width)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which each row of ``a`` and each of ``b`` agree; rows that are equal count as 0."""
    return (a[:, None, :] != b[None, :, :]).argmax(axis=2)


def _near_pairs(words: list[str], keys: np.ndarray, size: np.ndarray, head: np.ndarray, tail: np.ndarray):
    """Places (i, j) of near words of one group; ``keys`` is sorted and tells the groups apart."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    at, found = 0, []
    blocks = []
    while at < len(words):  # as many words as fit a tile of their width
        width = int(lengths[at : at + TILE_WORDS].max(initial=1))
        to = min(len(words), at + max(1, min(TILE_WORDS, int((TILE_CELLS / width) ** 0.5))))
        mine = words[at:to]
        blocks.append((at, to, mine, [w[::-1] for w in mine]))
        at = to
    for p, (a, a_end, front_a, back_a) in enumerate(blocks):
        for b, b_end, front_b, back_b in blocks[p:]:
            if keys[b] != keys[a_end - 1] and b != a:
                break
            width = int(max(lengths[a:a_end].max(), lengths[b:b_end].max()))
            prefix = _alike(_matrix(front_a, width), _matrix(front_b, width))
            suffix = _alike(_matrix(back_a, width), _matrix(back_b, width))
            la, lb = lengths[a:a_end, None], lengths[None, b:b_end]
            near = prefix + suffix >= np.maximum(la, lb) - 1
            near &= (keys[a:a_end, None] == keys[None, b:b_end]) & (np.abs(la - lb) <= 1)
            near &= np.minimum(la, lb) == size[a:a_end, None]
            # The place of the edit lies between head and tail.
            t = tail[a:a_end, None]
            near &= (prefix >= head[a:a_end, None]) & ((t == 0) | (prefix < size[a:a_end, None] - t))
            if a == b:
                near &= np.triu(np.ones(near.shape, bool), 1)
            i, j = np.nonzero(near)
            found.append((i + a, j + b))
    none = np.zeros(0, np.int64)
    return [np.concatenate([none, *[f[k] for f in found]]) for k in (0, 1)]


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (``a``, ``n_a``, ``b``, ``n_b``) of (``word``, ``n``) that differ by one inserted, deleted or
    replaced code point, each pair once. Words must be distinct."""
    schema = "a string, n_a long, b string, n_b long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def compared(table: pa.Table) -> pa.RecordBatch:
            column = lambda c: table[c].to_numpy()
            texts = {c: table[c].to_pylist() for c in ("word", "front", "back")}
            key = list(zip(column("length").tolist(), column("head").tolist(), column("tail").tolist(), texts["front"], texts["back"]))
            new = np.fromiter((i > 0 and key[i] != key[i - 1] for i in range(len(key))), np.int64, len(key))
            i, j = _near_pairs(texts["word"], new.cumsum(), column("length"), column("head"), column("tail"))
            take = lambda c, at: table[c].take(pa.array(at)).combine_chunks()
            arrays = [take("word", i), take("n", i), take("word", j), take("n", j)]
            return pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in arrays], names)

        def last_group(table: pa.Table) -> int:
            """Where the last group begins."""
            mask = np.ones(table.num_rows, bool)
            for c in _KEY:
                mask &= table[c].to_numpy() == table[c][-1].as_py()
            other = np.flatnonzero(~mask)
            return int(other[-1]) + 1 if len(other) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more]).combine_chunks()
            cut = last_group(held)
            if cut:
                yield compared(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield compared(held)

    groups = _groups(words.select("word", "n"))
    sorted_ = groups.repartition(*_KEY).sortWithinPartitions(*_KEY)
    return sorted_.mapInArrow(run, schema)


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` of (``word``, ``form``): the last form that forms lead to, by pointer jumping."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("of"), F.col("root").alias("ahead"))
        jumped = at.join(ahead, F.col("root") == F.col("of"), "left")
        moved = F.col("ahead").isNotNull()
        at = materialize(jumped.select("word", F.coalesce("ahead", "root").alias("root"), moved.alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of distinct words with their number ``n``.

    A word's form is its near word (:func:`near_words`) of the largest ``n``, of equal ones the first in
    code-point order, if that ``n`` is ``factor`` times the word's at least; else ``form`` and
    ``form_n`` are null. Numbers grow by the factor with each step, so forms never run in a circle;
    the root is where they end, the word itself without a form. ``n_near`` counts the near words.

    Null words are left out, repeated ones added up; other columns are not read. An empty table gives
    an empty one.
    """
    known = words.filter("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    known = materialize(known, "vocabulary")
    pairs = materialize(near_words(known), "near-words")
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("down"), F.col("b").alias("near")).alias("best")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("down"), F.col("a").alias("near")).alias("best")),
    )
    near = pairs.select(F.explode(ends).alias("e")).groupBy(F.col("e.word").alias("word"))
    near = near.agg(F.count(F.lit(1)).alias("n_near"), F.min("e.best").alias("best"))
    joined = known.join(materialize(near, "best-forms"), "word", "left")
    enough = -F.col("best.down") >= factor * F.col("n")
    formed = joined.select(
        "word",
        F.when(enough, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.down")).alias("form_n"),
    )
    formed = materialize(formed, "forms")
    roots = follow_forms(formed.filter("form is not null"))
    rows = formed.join(roots, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
