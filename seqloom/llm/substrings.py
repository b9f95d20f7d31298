"""Substring dedup: windows of words that a document with a smaller id has too are removed.

A sketch of counts keeps almost all other windows out of the exact grouping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.words import WordHashes, mixed, split_words, window_hashes
from seqloom.session import drop_scratch, materialize, scratch_path

WINDOW = 50
GRAM = 16  # words of a fingerprint; every window holds one
# Cells of one row of the sketch: eight for each fingerprint, within these bounds. Two rows of two
# bits a cell; what is sent to the tasks is one bit a cell, at most 32 MB for both rows.
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27
SEGMENT = 1 << 14
_ROWS = 512
_SECOND = np.uint64(0xA0761D6478BD642F)


def _grams(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window the place of its least one (the first of equals)."""
    grams = window_hashes(hashes, gram)
    width = window - gram + 1
    if len(grams) < width:
        return grams, np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    return grams, least + np.arange(len(least))


def _text_key(words: list[bytes]) -> tuple[str, int]:
    digest = hashlib.sha256(b" ".join(words)).digest()
    return digest.hex(), int.from_bytes(digest[:8], "little", signed=True)


def _batches(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _summaries(window: int, gram: int):
    names = ["doc_id", "n_words", "sha", "key", "fingerprints"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch, rows = whole.slice(at, _ROWS), []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    words = split_words(text.as_py())
                    grams, least = _grams(known.of(words), window, gram)
                    prints = np.unique(grams[np.unique(least)]) if doc is not None else grams[:0]
                    rows.append((doc, len(words), *_text_key(words), prints.tobytes()))
                yield _batches(rows, names, kinds)

    return summarize


def _cells(prints: np.ndarray, cells: int) -> list[np.ndarray]:
    mask = np.uint64(cells - 1)
    return [prints & mask, (prints >> np.uint64(32)) & mask]


def _partial_sketch(cells: int):
    """Per task, row and segment the cells that were hit, and among them those hit twice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.frombuffer(b"".join(batch.column("fingerprints").to_pylist()), np.uint64)
            rows = []
            for row, hit in enumerate(_cells(prints, cells)):
                cell, times = np.unique(hit, return_counts=True)
                segment = (cell // np.uint64(SEGMENT)).astype(np.int64)
                inside = (cell % np.uint64(SEGMENT)).astype("<u2")
                cuts = np.flatnonzero(np.diff(segment)) + 1
                for s, c, t in zip(*(np.split(x, cuts) for x in (segment, inside, times))):
                    if len(s):
                        rows.append((row, int(s[0]), c.tobytes(), c[t > 1].tobytes()))
            yield _batches(rows, ["line", "segment", "hit", "twice"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return count


def _merged(state: pa.Table) -> pa.Table:
    """One segment of one row: the bits of the cells whose summed count reaches two."""
    counts = np.zeros(SEGMENT, np.uint8)
    for name in ("hit", "twice"):
        for part in state.column(name):
            counts[np.frombuffer(part.as_buffer(), "<u2")] += 1  # each cell once in a part
            np.minimum(counts, 2, out=counts)
    bits = np.packbits(counts > 1, bitorder="little").tobytes()
    first = {n: state.column(n)[:1] for n in ("line", "segment")}
    return pa.table({**first, "bits": pa.array([bits], pa.binary())})


def repeated_cells(summaries: DataFrame, cells: int) -> np.ndarray:
    """Bits of the merged sketch, a row of ``cells`` for each of the two hashes: set where the count of
    fingerprints is two or more. A fingerprint in two documents has both its bits set."""
    partial = summaries.select("fingerprints").mapInArrow(
        _partial_sketch(cells), "line int, segment long, hit binary, twice binary"
    )
    merged = partial.groupBy("line", "segment").applyInArrow(_merged, "line int, segment long, bits binary")
    bits = np.zeros((2, max(1, cells // 8)), np.uint8)
    size = SEGMENT // 8
    for r in merged.toLocalIterator():
        bits[r["line"], r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _set(bits: np.ndarray, prints: np.ndarray, cells: int) -> np.ndarray:
    """Which fingerprints the sketch takes for repeated."""
    found = np.ones(len(prints), bool)
    for row, cell in zip(bits, _cells(prints, cells)):
        found &= (row[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _windows(shared, cells: int, window: int, gram: int):
    """The windows whose fingerprint is estimated repeated, by two 64-bit hashes."""
    names = ["h1", "h2", "doc_id", "key", "at"]
    kinds = [pa.int64()] * 4 + [pa.int32()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = WordHashes(), shared.value
        seen: dict[int, int] = {}  # least id of each text in this task: later copies add nothing
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = split_words(text.as_py())
                if doc is None or len(words) < window:
                    continue
                hashes = known.of(words)
                grams, least = _grams(hashes, window, gram)
                at = np.flatnonzero(_set(bits, grams[least], cells)).astype(np.int32)
                if not len(at):
                    continue
                key = _text_key(words)[1]
                if seen.get(key, doc + 1) <= doc:
                    continue
                if len(seen) >= 1 << 16:
                    seen.clear()
                seen[key] = doc
                columns = [window_hashes(h, window)[at].view(np.int64) for h in (hashes, mixed(hashes ^ _SECOND))]
                columns += [np.full(len(at), doc), np.full(len(at), key), at]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return find


def _kept(window: int):
    names = ["doc_id", "key", "n_removed", "kept_sha", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n) for n in ("doc_id", "text", "key", "at")]
            for doc, text, key, at in zip(*columns):
                words = split_words(text.as_py())
                if _text_key(words)[1] != key.as_py():
                    continue  # another text under the same id
                starts = np.asarray(at.values.to_numpy(zero_copy_only=False))
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, starts + window, -1)
                keep = np.cumsum(edges[:-1]) == 0
                left = b" ".join(w for w, k in zip(words, keep.tolist()) if k)
                row = (doc.as_py(), key.as_py(), int((~keep).sum()), hashlib.sha256(left).hexdigest(), left.decode())
                yield _batches([row], names, kinds)

    return cut


def substring_dedup(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    text: str = "text",
    doc_id: str = "doc_id",
    texts: bool = True,
) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``, ``kept``: the words left,
    joined by one space.

    A word goes if it lies in a window of ``window`` words whose words also begin in a document with
    a smaller id; windows are judged on the input.

    1. Exact copies of a text, found by its digest, lose all their words if they have a window.
    2. Of every window the least hash of its grams is its fingerprint, so equal windows have equal
       ones. The tasks count the fingerprints of the distinct texts in sketches; the merged sketch
       never has less than the true count.
    3. Only windows whose fingerprint is estimated repeated are grouped, by 128 bits of hash, for the
       least id of each. A window that occurs in one document alone drops out there.

    ``doc_id`` is a whole number. Rows without an id take no part: they keep all words and remove
    none. Rows with the same id don't remove from each other. Null and empty texts have no words,
    texts shorter than a window keep theirs. Other columns are not read. Empty tables give empty
    ones.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_words long, sha string, key long, fingerprints binary"
    every = materialize(read.mapInArrow(_summaries(window, gram), schema), "summaries")
    groups = every.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    groups = materialize(groups.filter("first_id < last_id").drop("last_id"), "copied")
    marked = every.join(groups, "sha", "left").withColumn("copy", F.coalesce(F.expr("first_id < doc_id"), F.lit(False)))

    prints = every.agg(F.sum(F.octet_length("fingerprints"))).first()[0] or 0
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << int(prints).bit_length()))  # 8 bytes each: 8 cells or more
    bits = spark.sparkContext.broadcast(repeated_cells(marked.filter("not copy"), cells))
    schema = "h1 long, h2 long, doc_id long, key long, at int"
    windows_at = scratch_path(spark, "windows")
    read.mapInArrow(_windows(bits, cells, window, gram), schema).write.parquet(windows_at)
    windows = spark.read.parquet(windows_at)
    firsts = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = materialize(firsts.filter("first < last").drop("last"), "repeated")
    later = windows.join(firsts, ["h1", "h2"]).filter("first < doc_id").select("doc_id", "key", "at")
    later = materialize(later.groupBy("doc_id", "key").agg(F.collect_list("at").alias("at")), "removed")
    drop_scratch(spark, windows_at)

    left = read.join(later, "doc_id").mapInArrow(
        _kept(window), "doc_id long, key long, n_removed long, kept_sha string, kept string"
    )
    left = left if texts else left.drop("kept")
    left = left.dropDuplicates(["doc_id", "key"])
    gone = F.col("copy") & (F.col("n_words") >= window)
    nothing = hashlib.sha256(b"").hexdigest()
    rows = marked.drop("fingerprints").join(left, ["doc_id", "key"], "left")
    out = rows.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        "key",
        *([F.when(gone, "").otherwise(F.col("kept")).alias("kept")] if texts else []),
    )
    if not texts:
        return out.drop("key")
    whole = read.mapInArrow(_rejoined, "doc_id long, key long, whole string").dropDuplicates(["doc_id", "key"])
    whole = whole.withColumnsRenamed({"doc_id": "id", "key": "of"})
    full = out.join(whole, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")))
    return full.select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("kept", "whole").alias("kept"))


def _rejoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = split_words(text.as_py())
            row = (doc, _text_key(words)[1], b" ".join(words).decode())
            yield _batches([row], ["doc_id", "key", "whole"], [pa.int64(), pa.int64(), pa.string()])
